"""The registered pipeline from end to end, against plain stages, on the small tables with awkward rows among them."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_near_texts import kept as near_kept
from tests.llm.test_quality_plain import plain as plain_quality
from tidewake.llm import bpe, mixing

LONG = "A long report follows and it says what was seen on each of the days. " * 900


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents and labels: the small ones, and null, empty, repeated, long and near-alike texts with ids of their own."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own = [r for r in docs.collect() if r["lang"] == "en"][:4]
    more = [(9000, None, "en", "src1", 0), (9001, "", None, None, 0), (9002, " \n\t", "en", "src2", 3), (9003, LONG, "en", "src3", len(LONG)), (9004, LONG + "The end.", "en", "src3", len(LONG) + 8)]
    more += [(9005, own[0]["text"], "en", "odd", None), (9006, own[1]["text"] + " Then it ended.", None, "src7", None)] + [(9007, own[2]["text"], "de", "src4", 1)] * 2 + [(9007, own[2]["text"], "en", "src4", 1)]
    docs.union(spark.createDataFrame(more, docs.schema)).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d


def plain_mix(rows, tokens):
    """Half of all tokens by the production weights: of each leaf the longest prefix by the seeded places."""
    digits = lambda s: s[len(s.rstrip("0123456789")) :]
    leaves, held = {}, []
    for r in rows:
        source, text = r["source"], r["text"] or ""
        domain = "" if source is None else "other" if not digits(source) else f"d{int(digits(source)) % 4}"
        h = hashlib.md5(f"20|{r['doc_id']}|{text}".encode()).hexdigest()
        held.append((r["doc_id"], (domain, r["lang"] or "", source or ""), tokens(text), h))
        leaves[held[-1][1]] = leaves.get(held[-1][1], 0) + held[-1][2]
    budgets = mixing.budgets(leaves, sum(leaves.values()) // 2, [mixing.DOMAINS, mixing.LANGS, {}], 1)
    out = set()
    for leaf, n in leaves.items():
        whole, rest = (1, 0) if not n else divmod(budgets[leaf], n)
        place = lambda h, w=whole: hashlib.md5(f"{h}:{w}".encode()).hexdigest()
        upto = 0
        for i, _, t, h in sorted((x for x in held if x[1] == leaf), key=lambda x: place(x[3])):
            upto += t
            if whole or (rest and upto <= rest):
                out.add(i)
    return out


def test_run_against_plain_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{tables}/labels.parquet").collect()]
    scores = plain_quality([(r["doc_id"], r["text"]) for r in docs], labels)
    good = [r for r, (_, _, top) in zip(docs, scores, strict=True) if top >= 0.5]
    winners = {w[0] for w in brute.exact([(r["doc_id"], r["text"]) for r in good]) if w[3]}
    single = {}
    for r in good:  # of rows alike in id and text the least
        if r["doc_id"] in winners and (r["doc_id"] not in single or brute_order(r) < brute_order(single[r["doc_id"]])):
            single[r["doc_id"]] = r
    rows = [single[i] for i in sorted(single)]
    stay = near_kept([(r["doc_id"], r["text"]) for r in rows])
    near = [r for r in rows if r["doc_id"] in stay]
    counter = Tokenizer.from_file(public_tokenizers.path(bpe.COUNTER))
    chosen = plain_mix(near, lambda t: len(counter.encode(t, add_special_tokens=False).ids))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    want = set()
    for r in near:
        if r["doc_id"] in chosen:
            ids = coder.encode_ordinary(r["text"] or "")
            want.add((r["doc_id"], len(ids), brute.sha(b"".join(i.to_bytes(4, "little") for i in ids)), brute.sha((r["text"] or "").encode())))
    got = [tuple(r) for r in corpus_pipeline.run(spark, tables).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(docs) > len(good) > len(rows) > len(near) > len(want) > 0


def brute_order(r):
    return tuple((v is not None, v if v is not None else 0) for v in r)


def test_an_empty_table(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_without_labels_all_documents_go_on(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["quality classifier"]
    none = spark.read.parquet(f"{tables}/labels.parquet").where("false")
    from tidewake.llm import quality

    assert quality.keep_good(docs, none).count() == docs.count() and stage(spark, docs, tables).columns == docs.columns
