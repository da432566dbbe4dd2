"""The filter audit against counting document by document in every order."""

import itertools
import re

import numpy as np
import pytest

from tests.llm import brute
from tidewake.llm import filter_audit

LABELS = [(100, 1, 0), (100, None, 1), (101, 1, None), (203, 0, 1), (301, 1, 1), (400, 1, 0), (None, 1, 1), (5, 1, 0), (999_999, 1, 1)]


def plain(rows, labels):
    """rows: (doc_id, text, lang)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {c for c, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), i is not None and i > first[t]), strict=True) if bad}
        docs.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own, made, total = [d for d in docs if d[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                left = [d for d in own if not d[1] & set(order[:k])]
                hit = [d for d in left if f in d[1]]
                total[f] += len(hit)
                made.append((part, "".join(order), k + 1, len(left) - len(hit), len(hit), sum(f in d[1] for d in own) - len(hit), sum(d[1] == {f} for d in own), sum(d[2] for d in hit), sum(d[3] for d in hit), f))
        out += [(*m[:-1], total[m[-1]]) for m in made]
    return sorted(out)


def rows_of(got):
    return sorted((r["part"], r["filter_order"], r["step"], *[r[c] for c in filter_audit.FIGURES], r["shapley"]) for r in got.collect())


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_every_order_counted_by_document(spark, labels):
    data = brute.awkward(long_words=3000) + [(900 + k, "SHOUT & repeat " * 40, None, None, 1, "en", None) for k in range(6)] + [(None, "SHOUT & repeat " * 40, None, None, 1, "en", None)]
    docs = spark.createDataFrame(data, brute.SCHEMA).repartition(4)
    got = rows_of(filter_audit.audit(filter_audit.cells(docs, labels), "ABCDE"))
    assert got == plain([(r[0], r[1], r[5]) for r in data], LABELS)
    assert len(got) == 600 * len({r[5] or "" for r in data})
    shapley = {(r[0], r[1][r[2] - 1]): r[-1] for r in got}
    for part in {r[0] for r in got}:  # over all orders the filters share what all of them remove
        removed = sum(r[4] for r in got if r[0] == part and r[1] == "ABCDE")
        assert sum(v for (p, _), v in shapley.items() if p == part) == 120 * removed


def test_tables_without_rows(spark, labels):
    docs = spark.createDataFrame([], brute.SCHEMA)
    assert filter_audit.audit(filter_audit.cells(docs, labels), "ABCDE").collect() == []
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    got = rows_of(filter_audit.audit(filter_audit.cells(docs, labels.limit(0)), "ABCDE"))
    assert got == plain([(1, None, None)], [])


def test_other_filters(spark, labels):
    docs = spark.createDataFrame([(1, "a a", "x"), (2, "a", "x"), (3, "B", "y")], "doc_id long, text string, lang string").withColumns({"mask": filter_audit.F.lit(9), "n": filter_audit.F.lit("t")})
    got = filter_audit.audit(filter_audit.cells(docs, labels, {"s": lambda t: filter_audit.F.char_length(t) < 2, "u": lambda t: t.rlike("[A-Z]")}, copies=False), "su")
    assert {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"]) for r in got.collect()} == {
        ("x", "su", 1): (1, 1, 0), ("x", "su", 2): (1, 0, 0), ("x", "us", 1): (2, 0, 0), ("x", "us", 2): (1, 1, 0),
        ("y", "su", 1): (0, 1, 0), ("y", "su", 2): (0, 0, 1), ("y", "us", 1): (0, 1, 0), ("y", "us", 2): (0, 0, 1)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_walk_visits_every_order_by_single_swaps(n):
    places = list(filter_audit.swaps(n))
    order, seen = list(range(n)), {tuple(range(n))}
    for k in places:
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n))) and len(places) == len(seen) - 1


def test_figures_after_swaps_are_those_made_anew():
    counts = np.random.default_rng(1).integers(0, 50, (16, 3))
    orders, steps, removed = filter_audit.walk(counts, 4)
    fresh = np.zeros(4, np.int64)
    for order, own in zip(orders, steps, strict=True):
        before = 0
        for f, row in zip(order, own, strict=True):
            hit = [m for m in range(16) if m >> f & 1 and not m & before]
            assert row[1] == counts[hit, 0].sum() and row[4] == counts[hit, 1].sum() and row[0] == counts[[m for m in range(16) if not m & (before | 1 << f)], 0].sum()
            fresh[f] += row[1]
            before |= 1 << f
    assert (fresh == removed).all()
