"""Operators on documents against plain versions, on awkward rows and on the small tables."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.llm import brute
from tidewake.llm import bpe, exact_dedup, line_dedup, registry, simhash, span_dedup
from tidewake.llm.common import pack, unpack


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.awkward(), brute.SCHEMA).repartition(3, "keep_key", "n")


@pytest.fixture(scope="module")
def rows():
    return [r[:2] for r in brute.awkward()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def ordered(got):
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


def test_lines_of_a_larger_table(spark):
    """The registered query over 1,000 documents, where runs of several levels share lines."""
    data = DATA.replace("sf0.001", "sf0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(registry.QUERIES["op1_line_dedup"](spark, data).collect()) == ordered(brute.lines(rows))


def test_lines(docs, rows, empty):
    run = lambda d: [(r["doc_id"], r["n_lines"], r["n_dropped"], brute.sha(r["kept_text"].encode())) for r in line_dedup.dedup_lines(d).collect()]
    assert ordered(run(docs)) == ordered(brute.lines(rows))
    assert any(r[2] for r in brute.lines(rows))
    assert run(empty) == []


def test_texts_of_many_repeated_lines(spark):
    text = "\n".join(f"Line {k} of many" for k in range(20_000))
    rows = [(k, text + f"\nown {k}") for k in range(11)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got} == {(k, 20_001, 20_000, f"own {k}") for k in range(11)}


def test_line_runs_over_many_batches(spark):
    from tidewake.llm.common import Scratch

    runs = line_dedup.LineRuns(Scratch(spark, "t"), min_docs=5, fanout=2)
    schema = "hi long, lo long, docs long"
    for k in range(7):
        new = spark.createDataFrame([(1, 1, 3), (2, 2, 1), (10 + k, 0, 1)], schema)
        fresh = {r["hi"] for r in runs.new_lines(new).collect()}
        assert fresh == ({1, 2, 10} if k == 0 else {10 + k})
        runs.add(new)
    assert {r["hi"] for r in runs.repeated().collect()} == {1, 2}
    assert sum(map(len, runs.levels)) <= 3  # 7 batches as runs of 4, 2 and 1


def test_exact(docs, rows, empty):
    want = brute.exact(rows)
    assert ordered(exact_dedup.dedup_report(docs).collect()) == ordered(want)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert ordered((r["doc_id"], r["text"] or "") for r in kept.collect()) == ordered((w[0], t) for w in want if w[3] for t in {x or "" for i, x in rows if i == w[0] and brute.sha((x or "").encode()) == w[4]})
    assert exact_dedup.dedup_report(empty).collect() == [] and exact_dedup.drop_copies(empty).collect() == []


def test_perfect_hash_is_minimal_and_round_trips():
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    made = exact_dedup.PerfectHash.loads(exact_dedup.PerfectHash.build(digests).dumps())
    assert sorted(made.slots(digests).tolist()) == list(range(5000)) and made.size == 5000
    others = made.slots([hashlib.sha256(f"x{k}".encode()).digest() for k in range(500)])
    assert ((others >= -1) & (others < 5000)).all()
    shallow = exact_dedup.PerfectHash.build(digests[:100], load=1.0, depth=1)  # most keys are left over and listed
    assert sorted(shallow.slots(digests[:100]).tolist()) == list(range(100))


def test_fingerprints_and_components(docs, rows, empty):
    got = simhash.components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert ordered(got) == ordered(brute.components(rows))
    assert simhash.components(empty).collect() == []
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    named = brute.components(rows)
    classes = {r for r in brute.roots([brute.simhash(t) for _, t in rows])}
    assert kept.count() == len(classes)
    assert {r["doc_id"] for r in kept.collect()} == {c for *_, c in named}


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_of_crowded_keys(spark, crowd):
    """Groups of near fingerprints, paired or by midpoints, with the components of all pairs."""
    rng = np.random.default_rng(1)
    prints = set()
    for _ in range(6):
        p = int(rng.integers(0, 1 << 63))
        for _ in range(30):
            prints.add(p)
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                p ^= 1 << int(bit)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    from tidewake.llm.common import Scratch
    from tidewake.llm.components import star_components

    scratch = Scratch(spark, "t")
    root = {r["node"]: r["root"] for r in star_components(simhash.links(df, scratch, crowd=crowd), scratch).collect()}
    want = brute.roots(prints)
    mine = [root.get(simhash._signed(p), simhash._signed(p)) for p in prints]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_small_tables_have_the_components_of_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert ordered(simhash.op7_simhash_near_dedup(spark, DATA).collect()) == ordered(brute.components(rows))


def test_spans(docs, rows, empty):
    got = span_dedup.dedup_spans(docs).select("doc_id", "n_sentences", "n_removed", F.sha2("kept", 256)).collect()
    # rows with one doc_id and several texts are compared by all but the order between those texts
    assert ordered(got) == ordered(brute.spans(rows))
    assert span_dedup.dedup_spans(empty).collect() == []


def test_a_repeated_passage_goes_whole(spark):
    passage = "First comes this. Then it says a little more of the same kind! And then, at length, it goes on and on about nothing at all until it stops? Short end.\n"
    rows = [(k, f"Own words of number {k} stand here. Alone {k}.\n{passage}Ending {k}.") for k in range(5)]
    got = {r["doc_id"]: r for r in span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0 and all(bytes(got[k]["kept"]).decode() == rows[k][1].replace(passage, "") for k in range(1, 5))
    lone = "word " * 45 + "end.\n"
    rows = [(k, f"Start {k}.\n{lone}Stop {k}.") for k in range(3)]
    got = {r["doc_id"]: r["n_removed"] for r in span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_spans_of_the_small_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert ordered(span_dedup.op9_span_dedup(spark, DATA).collect()) == ordered(brute.spans(rows))


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})


def encoded(rows, coder):
    out = []
    for i, t in rows:
        ids = coder.encode_ordinary(t or "")
        out.append((i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha((t or "").encode())))
    return out


def test_encoding(docs, rows, empty, coder):
    path = public_tokenizers.path(bpe.RANKS)
    assert ordered(bpe.encode(docs, path).collect()) == ordered(encoded(rows, coder))
    assert bpe.encode(empty, path).collect() == []
    got = bpe.encode(docs, path, with_ids=True)
    back = bpe.decode(got, path).join(got.select("doc_id"), "doc_id").distinct().collect()
    texts = {(i, (t or "").encode()) for i, t in rows if i is not None}
    assert {(r["doc_id"], bytes(r["text"])) for r in back} == texts


def test_encoding_of_the_small_tables(spark, coder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert ordered(bpe.op6_byte_bpe(spark, DATA).collect()) == ordered(encoded(rows, coder))


def test_words_of_any_script_split_alike(spark, coder):
    rng = np.random.default_rng(0)
    texts = ["".join(chr(c) for c in rng.choice([*range(32, 127), 0x85, 0xA0, 0x2003, 0x3000, 0xE9, 0x416, 0x4E2D, 0x661, 0x1F600, 0x301, 9, 10, 13], 80)) for _ in range(300)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(bpe.encode(df, public_tokenizers.path(bpe.RANKS)).collect()) == ordered(encoded(rows, coder))


def counted(rows):
    t = Tokenizer.from_file(public_tokenizers.path(bpe.COUNTER))
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in rows]
    return [(i, len((x or "").encode()), k, k > 512) for (i, x), k in zip(rows, n, strict=True)]


def test_counts(docs, rows, empty, spark):
    path = public_tokenizers.path(bpe.COUNTER)
    assert ordered(bpe.count_tokens(docs, path).collect()) == ordered(counted(rows))
    assert bpe.count_tokens(empty, path).collect() == []
    small = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert ordered(bpe.op8_token_counts(spark, DATA).collect()) == ordered(counted(small))


def test_packing():
    arrays = [np.array([0, 1, 255]), np.array([256, 70_000]), b"bytes", np.array([], np.uint32), np.array([(1 << 32) - 1])]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert a == b if isinstance(a, bytes) else a.tolist() == b.tolist()
