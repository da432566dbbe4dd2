"""Pivot tables: bounds, candidates and what they discard."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from tidewake.llm import simhash
from tidewake.llm.common import Scratch
from tidewake.llm.shingles import AGREE, WORDS, most_alike, shingles, short, similarity, sketch


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def prints_of(spark, prints):
    return spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")


def test_coordinates_are_distances_to_the_parts_pivots(spark):
    rng = np.random.default_rng(0)
    prints = [int(p) for p in rng.integers(0, 1 << 64, 40, dtype=np.uint64)] + [0, (1 << 64) - 1]
    got = prints_of(spark, prints).select("fp", *[simhash.coordinates(F.col("fp"), k).alias(f"c{k}") for k in range(simhash.PARTS)]).collect()
    for r in got:
        p = r["fp"] % (1 << 64)
        for k in range(simhash.PARTS):
            want = [(p >> 16 * k & 0xFFFF ^ q).bit_count() for q in simhash.REFERENCE[k]]
            assert [(r[f"c{k}"] >> 8 * i) & 255 for i in range(simhash.PIVOTS)] == want


def test_every_linked_pair_shares_a_key_and_passes_the_bound(spark):
    """All pairs of fingerprints within two bits are among the candidates, and the pivots let them pass."""
    rng = np.random.default_rng(1)
    prints = set()
    for _ in range(60):
        p = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        prints.add(p)
        for n in (1, 2, 2, 3, 4, 6):
            q = p
            for bit in rng.choice(64, n, replace=False):
                q ^= 1 << int(bit)
            prints.add(q)
    prints = sorted(prints)
    near = {(simhash._signed(a), simhash._signed(b)) for a in prints for b in prints if a != b and distance(a, b) <= 2}
    pairs = simhash.candidates(simhash.tables(prints_of(spark, prints))).distinct()
    possible, linked = simhash.near(pairs, 2)
    got = pairs.select("a", "b", possible.alias("possible"), linked.alias("linked")).collect()
    mine = {(r["a"], r["b"]) for r in got if r["linked"]}
    assert mine == {(a, b) for a, b in near if a < b}
    assert all(r["possible"] for r in got if r["linked"])
    assert sum(not r["possible"] for r in got) > 0.5 * sum(not r["linked"] for r in got)  # the bound does discard
    linked_ = {(r["a"], r["b"]) for r in simhash.links(prints_of(spark, prints), Scratch(spark, "t")).collect()}
    assert linked_ == mine


def test_short_sets_bound_the_similarity():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 300, 2048, 2049, 9000):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        for share in (0.0, 0.5, 0.85, 1.0):
            b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(0, 1 << 64, 1 + n // 9, dtype=np.uint64)]))
            bound, exact = most_alike(short(a), short(b), len(a), len(b)), similarity(a, b) if len(a) + len(b) else 0.0
            assert exact <= bound and (n > 3000 or bound <= exact + 0.2)


def test_sketches_agree_where_texts_are_alike():
    rng = np.random.default_rng(3)
    worst = []
    for n in (60, 400, 3000):
        for _ in range(60):
            both = rng.integers(0, 1 << 64, int(n * 0.8), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 64, n // 10, dtype=np.uint64)])) for _ in range(2))
            same = 0
            for x, y in zip(sketch(a).tolist(), sketch(b).tolist(), strict=True):
                same += sum((x ^ y) >> 4 * k & 15 == 0 for k in range(16))
            worst.append(same)
    assert min(worst) >= AGREE and abs(np.mean(worst) - 0.8125 * 16 * WORDS) < 4


def test_words_without_shingles_meet_nobody(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (6, "two")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(docs, jaccard=0.8).collect()}
    zero = [k for k, t in ((1, None), (2, ""), (3, " \n")) if brute.simhash(t) == 0]
    assert {got[k] for k in zero} == {1} and got[4] == got[5] == 4 and got[6] == 6
    assert shingles(None).size == shingles(b" \n").size == 0
