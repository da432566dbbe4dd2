"""The manifest against a tree built plainly in memory, and proofs that find what was changed."""

import hashlib
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewake.llm import merkle
from tidewake.llm.common import Scratch


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def climb(tree, at, own):
    """Siblings and the digest that ``own`` leads to."""
    sib = ""
    for level in tree[:-1]:
        a = at - at % 8
        run = level[a : a + 8]
        sib += "".join(x for k, x in enumerate(run) if k != at % 8)
        run[at % 8] = own
        own, at = h("".join(run)), at // 8
    return sib, own


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        other = brute.lower(r[4]) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4]
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r[0], leaf((*r[:4], other))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees.append(levels([x[2] for x in groups[g]]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (g, tree) in enumerate(zip(names, trees, strict=True)):
        for at, (_, _, own, doc_id, told) in enumerate(groups[g]):
            s1, up = climb(tree, at, told)
            s2, folded = climb(top, k, up)
            out.append((doc_id, own, tree[-1][0], top[-1][0], h(s1 + s2), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted(map(tuple, got), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_awkward_rows(spark, tmp_path):
    data = [(i, s, g, None if k % 4 else k, t) for k, (i, t, _, _, _, g, s) in enumerate(brute.awkward(3000))]
    data += [(900, "s", "x" + chr(0x1F600), 1, "lone"), (901, "s", "x" + chr(0xFFEE), 1, "Lone"), (902, "s", "", 1, "lone"), (902, "s", "", 1, "lone")]
    docs = spark.createDataFrame(data, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in ("part", "row", "at", "tree", "path", "root")})
    got = run(spark, docs, tmp_path)
    assert got == plain(data)
    assert {g[6] for g in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 9], [7, 64, 65, 1], [1] * 20])
def test_trees_of_other_sizes(spark, tmp_path, sizes):
    data = [(k, None, f"g{g:02}", 1, f"T{k}") for g, n in enumerate(sizes) for k in range(100 * g, 100 * g + n)]
    assert run(spark, spark.createDataFrame(data, SCHEMA).repartition(3), tmp_path) == plain(data)


def test_a_tree_of_several_strides(spark, tmp_path):
    """Over 4,096 leaves: paths are handed down, frontiers dealt twice."""
    data = [(k, "s", "en" if k % 10 else "de", 1, f"Text {k}") for k in range(6000)]
    assert run(spark, spark.createDataFrame(data, SCHEMA).repartition(7), tmp_path) == plain(data)


def test_no_rows(spark, tmp_path):
    assert run(spark, spark.createDataFrame([], SCHEMA), tmp_path) == []


def test_partial_parents_meet_in_any_arrangement():
    """Leaves in any order over any number of tasks, combined again and again, make each node once."""
    leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(700)]
    names = ["tree", "level", "parent", "width", "spots", "kids"]
    event = lambda k: (1, 0, k >> 3, 700, bytes([k & 7]), leaves[k])
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
    made, left = [], []
    for task in range(9):
        for b in merkle._combine(iter([batch([event(k) for k in range(700) if k * 7919 % 9 == task])])):
            for r in b.to_pylist():
                (made if r["digest"] else left).append(r)
    for b in merkle._combine(iter([batch([tuple(r[n] for n in names) for r in left])])):
        assert all(r["digest"] for r in b.to_pylist())
        made += b.to_pylist()
    tree = levels([x.hex() for x in leaves])
    assert {(r["level"], r["parent"]): r["digest"].hex() for r in made} == {(k, j): x for k, level in enumerate(tree[1:]) for j, x in enumerate(level)}
    assert len(made) == sum(map(len, tree[1:]))


def test_a_proof_finds_changed_columns(spark):
    docs = spark.createDataFrame([(k, "s", "en", k, f"text {k}") for k in range(20)], SCHEMA)
    forged = F.when(F.col("doc_id") == 3, merkle.leaf(F.lit(3), F.lit("t"), F.lit("en"), F.lit(3), F.lit("text 3")))
    got = merkle.manifest(docs, claimed=forged).select("doc_id", (merkle.fold(F.col("claimed"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert {r["doc_id"]: r["ok"] for r in got} == {k: k != 3 for k in range(20)}


def test_frontiers_are_small(spark):
    """Tasks make nearly all nodes where their leaves lie: what moves is a few parents for each task."""
    leaves = spark.range(40_000).repartitionByRange(6, "id").sortWithinPartitions("id").select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("at"), F.lit(40_000).cast("long").alias("n"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    scratch = Scratch(spark, "t")
    runs, roots = merkle.grow(scratch, "x", leaves, merkle._depth(40_000))
    assert roots.count() == 1 and runs.count() == 5000 + 625 + 79 + 10 + 2 + 1
    assert spark.read.parquet(scratch.path("x_0")).where("digest is null").count() < 100
