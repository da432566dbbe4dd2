"""The pipeline's near-dedup stage on planted near copies, against all pairs."""

import itertools
import random

import pytest

import corpus_pipeline
from tests.llm import brute
from tidewake.llm import simhash
from tidewake.llm.shingles import shingles, similarity


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def kept(rows):
    sets, prints = [plain_shingles(t) for _, t in rows], [brute.simhash(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if root[i] != root[j] and (jaccard(sets[i], sets[j]) >= 0.8 or (prints[i] ^ prints[j]).bit_count() <= 2):
            old, new = root[j], root[i]
            root = [new if r == old else r for r in root]
    return {min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}


def planted(groups, copies, edits):
    """Texts of 150 words and copies with some words changed, apart from each other."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(150)]
        rows.append(base)
        for _ in range(copies):
            text = list(base)
            for at in rng.sample(range(10, 140), edits):
                text[at] = word()
            rows.append(text)
    return [(k, " ".join(t)) for k, t in enumerate(rows)]


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, "").collect()}


@pytest.mark.parametrize("groups, copies, edits", [(40, 2, 3), (2, 60, 2)])
def test_planted_near_copies_go(spark, groups, copies, edits):
    rows = planted(groups, copies, edits) + [(9000, None), (9001, "one two"), (9002, "One  two")]
    want = kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert stage(spark, rows) == want
    assert simhash.drop_near_copies(docs).count() > len(want)


def test_similarity_of_hashes_is_that_of_words():
    texts = [t for _, t in planted(2, 3, 4)] + ["a", "a b c d e", "a b c d e f", "a a a a a a a a"]
    for a, b in itertools.combinations(texts, 2):
        assert similarity(shingles(a.encode()), shingles(b.encode())) == jaccard(plain_shingles(a), plain_shingles(b))
