"""The classifier's query against features, fit and scores worked out one by one."""

import math
import re

import numpy as np
import pytest
import xxhash

from tests.conftest import DATA
from tidewake.llm import quality

BITS = 18
MARKS = " \t\n\r\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def number(kind, value):
    return xxhash.xxh3_64_intdigest(kind + value) % (1 << BITS)


def kind_of(c):
    return b"A" if 65 <= c <= 90 else b"a" if 97 <= c <= 122 or c >= 128 else b"0" if 48 <= c <= 57 else bytes([c])


def features(text):
    """{feature: value}: words, shapes, what repeats, and runs of four bytes."""
    raw = (text or "").encode()
    words, out = raw.split(), {}
    for w in words:
        core = w.strip(MARKS.encode()).lower()
        if core:
            out[number(b"w", core)] = 1.0
    shapes = [re.sub(rb"(.)\1+", rb"\1", b"".join(kind_of(c) for c in w), flags=re.S) for w in words]
    share = {}
    for s in shapes:
        share[number(b"s", s)] = share.get(number(b"s", s), 0) + 4.0 / len(words)
    out |= share
    if words:
        lines = raw.split(b"\n")
        rest = {b"repeated": 1 - len(set(words)) / len(words), b"lines": 1 - len(set(lines)) / len(lines), b"top": max(map(words.count, set(words))) / len(words), b"short": float(len(words) < 20)}
    else:
        rest = {b"empty": 1.0}
    out |= {number(b"x", k): 4.0 * v for k, v in rest.items()}
    low = b" " + raw.lower() + b" "
    for k in range(len(low) - 3):
        code = 0
        for c in low[k : k + 4]:
            code = code * 257 + c
        out[(1 << BITS) + (code * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - BITS)] = 1.0
    return out


def fitted(rows, grades):
    """Weights and two thresholds: 200 steps of Adam on the mean negative log-likelihood with a ridge."""
    held = {}
    for r in rows:
        for f in r:
            held[f] = held.get(f, 0) + 1
    used = sorted(f for f, n in held.items() if n >= 8 and (f < 1 << BITS or n <= max(8, 0.02 * len(rows))))
    x = np.array([[r.get(f, 0.0) for f in used] for r in rows], np.float32).astype(float)
    n = len(rows)
    base = [math.log(p / (1 - p)) for p in ((sum(g <= k for g in grades) + 0.5) / (n + 1) for k in range(2))]
    base[1] = max(base[0], base[1] + 1e-3)
    at = np.concatenate([np.zeros(len(used)), [base[0], math.log(max(base[1] - base[0], 1e-3))]])
    m = v = np.zeros_like(at)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, 201):
        low = at[-2]
        cuts = np.array([low, low + math.exp(at[-1])])
        score = x @ at[:-2]
        lo = np.array([0.0 if g == 0 else sig(cuts[g - 1] - s) for g, s in zip(grades, score, strict=True)])
        hi = np.array([1.0 if g == 2 else sig(cuts[g] - s) for g, s in zip(grades, score, strict=True)])
        p = np.maximum(hi - lo, 1e-12)
        slope_lo, slope_hi = lo * (1 - lo) / p, hi * (1 - hi) / p
        by_score = (slope_hi - slope_lo) / n
        by_cut = [sum((slope_lo[i] if grades[i] == k + 1 else 0) - (slope_hi[i] if grades[i] == k else 0) for i in range(n)) / n for k in range(2)]
        g = np.concatenate([x.T @ by_score + 5e-4 * at[:-2], [sum(by_cut), by_cut[1] * math.exp(at[-1])]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return dict(zip(used, at[:-2], strict=True)), at[-2], at[-2] + math.exp(at[-1])


def plain(docs, labels):
    """doc_id -> [(expected grade, P(top))] of rows (doc_id, text) by labels (doc_id, quality, toxic)."""
    grade = {}
    for i, q, t in labels:
        if i is not None and q is not None:
            grade[i] = min(grade.get(i, 9), 0 if (t or 0) > 0 else 2 if q > 0 else 1)
    texts = {}
    for i, t in docs:
        if i in grade:
            texts[i] = max(texts.get(i, ""), t or "", key=str.encode)
    chosen = sorted(texts)
    weights, low, high = fitted([features(texts[i]) for i in chosen], [grade[i] for i in chosen])
    out = []
    for i, t in docs:
        s = sum(weights.get(f, 0.0) * value for f, value in features(t).items())
        upto = [1 / (1 + math.exp(-max(-40, min(40, c - s)))) for c in (low, high)]
        out.append((i, 2 - sum(upto), 1 - upto[1]))
    return out


def test_query_against_the_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    want = {i: rest for i, *rest in plain(docs, labels)}
    got = quality.op2_quality_classifier(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["expected_grade"], r["p_top"]) == pytest.approx(want[r["doc_id"]], abs=1e-5)
        assert r["kept"] == (r["p_top"] >= 0.5)
