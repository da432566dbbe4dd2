"""Segments by their definition, token counts and scores against a plain version, calibration, and held-out rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm import brute
from tidewake.llm import toxicity
from tidewake.llm.toxicity import SIZE, Settings

BAD = ["vile", "rotten", "hateful"]


def corpus(n=400, seed=2):
    """Texts of random words; every fourth is toxic and holds a passage of bad words or of words of one bad stem."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = k % 4 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(BAD) for _ in range(3)] if k % 8 else [f"zrazo{word()}" for _ in range(4)]
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return docs, labels


@pytest.mark.parametrize("seed", range(5))
def test_segments_are_the_maximal_ones(seed):
    """The best contiguous part, then the same on both sides of it: what the linear scan must find."""
    rng = random.Random(seed)

    def plain(x, a, b):
        best = None
        for i in range(a, b):
            for j in range(i, b):
                s = sum(x[i : j + 1])
                if s > 0 and (best is None or s > best[0] + 1e-12):
                    best = (s, i, j)
        return [] if best is None else [*plain(x, a, best[1]), best[1:], *plain(x, best[2] + 1, b)]

    for _ in range(150):
        x = [rng.choice([-2, -1, -0.5, 0.25, 1, 3]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 16))]
        got = toxicity.segments(np.array(x, float))
        assert [g[:2] for g in got] == plain(x, 0, len(x))
        assert all(abs(s - sum(x[a : b + 1])) < 1e-9 for a, b, s in got)


def test_segments_of_a_long_text_take_linear_time():
    x = np.where(np.arange(600_000) % 3 == 0, 1.0, -0.499)  # each step merges with all before
    assert len(toxicity.segments(x)) == 1
    assert len(toxicity.segments(np.where(np.arange(600_000) % 3 == 0, 1.0, -2.0))) == 200_000


def numbers(word):
    """A word's number and those of its runs, one by one."""
    w = f" {word} ".encode().ljust(5)
    code = lambda run: sum(b * 257 ** (4 - k) for k, b in enumerate(run)) & 0xFFFFFFFFFFFFFFFF
    runs = [((code(w[k : k + 5]) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 44) + SIZE for k in range(len(w) - 4)]
    return xxhash.xxh3_64_intdigest(word.encode()) & (SIZE - 1), runs


def plain_odds(docs, labels, s=Settings()):
    toxic = dict(labels)
    counts, n = {}, [0, 0]
    for i, t in docs:
        if i in toxic and zlib.crc32(str(i).encode()) % 5 in (1, 2, 3):
            n[toxic[i]] += 1
            own = set()
            for w in {x.strip("!,.").lower() for x in t.split()} - {""}:
                a, runs = numbers(w)
                own |= {a, *runs}
            for a in own:
                counts.setdefault(a, [0, 0])[toxic[i]] += 1
    odds = {}
    for a, (c, t) in counts.items():
        more, extra = s.prior * (c + t), s.prior * sum(n)
        delta = math.log((t + more) / (n[1] + extra)) - math.log((c + more) / (n[0] + extra))
        score = max(0.0, abs(delta) - s.z * math.sqrt(1 / (t + more) + 1 / (c + more)))
        if score:
            odds[a] = math.copysign(score, delta)
    return odds


def test_odds_and_word_scores(spark):
    docs, labels = corpus()
    d, known = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), toxicity.labelled(spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = d.where(toxicity.fold(F.col("doc_id")).between(1, 3)).join(known, "doc_id").select("toxic", F.col("text").cast("binary").alias("text"))
    odds = toxicity.log_odds(texts, Settings())
    want = plain_odds(docs, labels)
    assert set(np.flatnonzero(odds)) == set(want) and all(abs(odds[a] - v) < 1e-5 for a, v in want.items())
    scanner = toxicity.Scanner(odds, Settings())
    for w in ["vile", "zrazonew", "ab", "a", "hateful", "unknown"]:
        own, runs = numbers(w)
        score = want.get(own) or max([0.0, *[want.get(r, 0.0) for r in runs]])
        assert abs(scanner.word_scores([w.encode()])[0] - (score - 0.5)) < 1e-5
    assert scanner.word_scores([b"vile"])[0] > 1 and scanner.word_scores([b"zrazonew"])[0] > 0.3
    ((n, found),) = scanner.many([b"so VILE! a b vile, rotten" + b" c" * 80 + b" vile"])
    assert n == 87 and [f[:2] for f in found] == [(1, 5), (86, 86)] or [f[:2] for f in found] == [(1, 1), (5, 5), (86, 86)]
    ((_, again),) = scanner.many([b"vile " * 400])
    assert [f[:2] for f in again] == [(0, 0)]  # what comes again at once says nothing new


def test_texts_alone_in_a_batch_or_with_others():
    scanner = lambda: toxicity.Scanner(np.random.default_rng(0).normal(0, 1, 2 * SIZE).astype("f4"), Settings())
    texts = [t.encode() if t is not None else None for _, t, *_ in brute.awkward(3000)]
    assert scanner().many(texts) == [scanner().many([t])[0] for t in texts]


def test_extremes_are_fitted():
    rng = np.random.default_rng(3)
    words = rng.integers(50, 2000, 20_000).astype(float)
    score = np.maximum(0, (np.log(0.02 * words) + rng.gumbel(size=len(words))) / 1.3)
    rate, k = toxicity.fit_extremes(score, words, np.ones(len(words)))
    assert abs(rate - 1.3) < 0.05 and abs(math.log(k / 0.02)) < 0.15
    assert toxicity.fit_extremes(np.zeros(3), np.ones(3), np.ones(3)) == (1.0, 0.25)
    # a clean text's evidence is -log of a uniform number: beyond x with probability exp(-x)
    got = np.array([toxicity.evidence([s] if s else [], int(w), rate, k) for s, w in zip(score, words, strict=True)])
    for x in (1.0, 2.0, 4.0):
        assert abs((got > x).mean() / math.exp(-x) - 1) < 0.25
    one, two = toxicity.evidence([9.0], 500, rate, k), toxicity.evidence([9.0, 8.0], 500, rate, k)
    assert two > one > 0 and toxicity.evidence([], 500, rate, k) == toxicity.evidence([], 0, rate, k) == 0


def test_logistic_by_hand():
    x, toxic, clean = np.array([0.0, 1.0]), np.array([10.0, 30.0]), np.array([30.0, 10.0])
    a, b = toxicity.fit_logistic(x, toxic, clean, ridge=1e-9)
    assert abs(a + math.log(3)) < 1e-5 and abs(b - 2 * math.log(3)) < 1e-5
    assert toxicity.fit_logistic(x, toxic * 0, clean)[1] == 0 and toxicity.fit_logistic(x[:0], x[:0], x[:0]) == (-20.0, 0.0)


def test_planted_passages_are_found(spark):
    docs, labels = corpus(800)
    d, known = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.detect(d, known)
    got = {r["doc_id"]: r for r in found.collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    toxic = [got[i]["score"] >= 0.5 for i in held if i % 4 == 0]
    clean = [got[i]["score"] >= 0.5 for i in held if i % 4]
    assert sum(toxic) > 0.85 * len(toxic) and sum(clean) < 0.05 * len(clean)
    passages = [(r["doc_id"], r["passage"]) for r in toxicity.passage_texts(d, found).collect()]
    assert {i for i, _ in passages} == {i for i, r in got.items() if r["passages"]}
    named = {i for i, p in passages if re.search("vile|rotten|hateful|zrazo", p)}
    assert sum(i in named for i in held if i % 4 == 0) > 0.85 * len(toxic) and not any(i % 4 for i in named)
    # a twentieth of a passage is expected in a clean text that wasn't learned from
    assert sum(i % 4 > 0 for i, _ in passages if i in set(held)) < 0.1 * len(clean)
    # labels of held-out rows are never looked at
    other = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels], "doc_id long, toxic int")
    assert {r["doc_id"]: r["score"] for r in toxicity.detect(d, other).select("doc_id", "score").collect()} == {i: r["score"] for i, r in got.items()}


def test_awkward_rows_and_labels(spark):
    docs, labels = corpus(120)
    data = [(i, t, "x", 1, None, "en", "s") for i, t in docs] + [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in brute.awkward(3000)]
    table = spark.createDataFrame(data, brute.SCHEMA).repartition(3).withColumns({c: F.lit(7) for c in ("words", "segments", "evidence", "toxic", "score")})
    known = spark.createDataFrame([*labels, (None, 1), (3, 0), (7, None), (99_999, 1)], "doc_id long, toxic int")
    got = toxicity.detect(table, known).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in data)
    assert all(0 <= r["score"] <= 1 for r in got) and {r["words"] for r in got if r["doc_id"] in (1200, 1201, 1202)} == {0}
    for rows in ([], [(1, 0)], [(k, 0) for k in range(120)]):
        got = toxicity.detect(table, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()
        assert len(got) == len(data) and max(r["score"] for r in got) < 0.5 and not any(r["passages"] for r in got)
    assert toxicity.detect(table.limit(0), known).collect() == []


def test_held_out_rows_of_the_small_table(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    got = toxicity.op13_toxicity(spark, data)
    assert got.select("doc_id").distinct().count() == got.count() == 1000
    rows = got.join(spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    toxic, clean = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    auc = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean)
    assert auc > 0.7
