"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(t_k - w.x) with thresholds t_0 < t_1 < ... and one weight vector w over hashed text for all grades. The
features of a text are its distinct words, stripped of marks and in lower case (presence), and the shapes of its words
(share of words): letters and digits become classes and runs collapse, so shouting, glued marks and lists show without
any word list. A few more say how often words and lines repeat, and the distinct runs of four bytes find telling parts of
words. Features that fewer than ``min_df`` sampled texts hold have no weight, nor runs that over ``common`` of them hold. Grades are fitted on a bounded sample of labelled rows, at most ``sample`` of them, those with the least
hash of their doc_id; every row of the table is scored on its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import Scratch, bound_batches, table

#: Words, shapes and the rest are hashed to the first SIZE weights, runs of bytes to the second.
BITS = 18
SIZE = 1 << BITS
RUN_BYTES = 4
#: Words that a worker remembers; longer ones are worked out each time, so that what is remembered stays small.
KNOWN, KNOWN_BYTES = 200_000, 64
_MARKS = b" \t\n\r\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def _hash(kind: bytes, value: bytes) -> int:
    return xxhash.xxh3_64_intdigest(kind + value) & (SIZE - 1)


def _word(w: bytes) -> tuple[int, int]:
    """The hashes of a word's core, -1 without one, and of its shape."""
    core = w.strip(_MARKS).lower()
    return _hash(b"w", core) if core else -1, _hash(b"s", _RUN.sub(rb"\1", w.translate(_CLASS)))


def _words(words: list[bytes]) -> list[tuple[int, int]]:
    """The same for many words, which hold no white space."""
    if not words:
        return []
    joined = b"\n".join(words)
    classes = np.frombuffer(joined.translate(_CLASS), np.uint8)
    ends = np.ones(len(classes), bool)
    ends[1:] = classes[1:] != classes[:-1]
    shapes = classes[ends].tobytes().split(b"\n")
    cores = [w.strip(_MARKS) for w in joined.lower().split(b"\n")]
    return [(_hash(b"w", core) if core else -1, _hash(b"s", shape)) for core, shape in zip(cores, shapes, strict=True)]


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text, each once, and their values."""
    text = text or b""
    counts = Counter(text.split())
    total = sum(counts.values())
    found: dict[int, float] = {}
    shapes: dict[int, int] = {}
    for w, n in counts.items():
        word, shape = _word(w)
        found[word] = 1.0
        shapes[shape] = shapes.get(shape, 0) + n
    found.pop(-1, None)
    for shape, n in shapes.items():
        found[shape] = 4.0 * n / total
    if total:
        lines = text.split(b"\n")
        extra = {b"repeated": 1 - len(counts) / total, b"lines": 1 - len(set(lines)) / len(lines), b"top": max(counts.values()) / total, b"short": 1.0 if total < 20 else 0.0}
    else:
        extra = {b"empty": 1.0}
    for name, value in extra.items():
        found[_hash(b"x", name)] = 4.0 * value
    return np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.float64, len(found))


def _codes(text: bytes | None) -> np.ndarray:
    """The hashed runs of RUN_BYTES bytes of a text in lower case, framed by blanks, one for each place."""
    b = np.frombuffer(b" " + (text or b"").lower() + b" ", np.uint8).astype(np.uint64)
    n = len(b) - RUN_BYTES + 1
    if n < 1:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.uint64)
    for k in range(RUN_BYTES):
        code = code * np.uint64(257) + b[k : n + k]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def runs(text: bytes | None) -> np.ndarray:
    """The hashed distinct runs of a text, behind the words' numbers."""
    return np.unique(_codes(text)) + SIZE


#: Features of every text that has words.
_EXTRA = [_hash(b"x", n) for n in (b"repeated", b"lines", b"top", b"short")]


class Scorer:
    """The scores of many texts under one model, each as ``Ordinal.score`` has it.

    A feature counts once, and of several of one number the last counts: words, then shapes, then the rest. So words and shapes that
    fall on another kind's number are left out.
    """

    def __init__(self, model: Ordinal):
        w = model.weights
        self.model, self.shapes, self.last = model, w[:SIZE].copy(), w[_EXTRA]
        self.shapes[_EXTRA] = 0.0
        self.words = self.shapes.copy()
        self.runs = w[SIZE:]
        self.telling = self.runs != 0
        self.at = np.zeros(SIZE, np.int32)  # where a number was seen last
        self.shaped = np.zeros(SIZE, bool)
        self.known: dict[bytes, int] = {}

    def _once(self, numbers: np.ndarray) -> np.ndarray:
        """Each number once."""
        order = np.arange(len(numbers), dtype=np.int32)
        self.at[numbers] = order
        return numbers[self.at[numbers] == order]

    def many(self, texts: list[bytes | None]) -> list[float]:
        """The scores of texts: words that are new to the worker are worked out together."""
        counts = [Counter((t or b"").split()) for t in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        new = list(set().union(*counts).difference(self.known))
        # a word's two numbers as one, its core's one higher
        self.known.update(zip(new, [core + 1 | shape << 32 for core, shape in _words(new)], strict=True))
        out = [self._one(t or b"", c) if c else self.model.score(t) for t, c in zip(texts, counts, strict=True)]
        for w in new:
            if len(w) > KNOWN_BYTES:
                del self.known[w]
        return out

    def _one(self, text: bytes, counts: Counter) -> float:
        both = np.fromiter(map(self.known.__getitem__, counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        total, word, shape = n.sum(), (both & 0xFFFFFFFF) - 1, both >> 32
        self.shaped[shape] = True
        word = self._once(word[word >= 0])
        score = self.words[word[~self.shaped[word]]].sum() + self.shapes[shape] @ n * (4.0 / total)
        self.shaped[shape] = False
        lines = text.split(b"\n")
        rest = (1 - len(counts) / total, 1 - len(set(lines)) / len(lines), n.max() / total, 1.0 if total < 20 else 0.0)
        codes = _codes(text)
        return float(score + self.last @ (4.0 * np.array(rest)) + self.runs[self._once(codes[self.telling[codes]])].sum())


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k below the top grade, a column each."""
        z = np.clip(self.thresholds[None, :] - score[:, None], -40, 40)
        return 1 / (1 + np.exp(-z))

    def score(self, text: bytes | None) -> float:
        at, value = features(text)
        return float(self.weights[at] @ value + self.weights[runs(text)].sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, min_df: int = 8, common: float = 0.02, ridge: float = 5e-4, steps: int = 200, rate: float = 0.05) -> Ordinal:
    """Full-batch Adam on the mean negative log-likelihood with a ridge; deterministic. With one grade only the scores are zero; without rows, too, and the top grade is near certain."""
    n_cut = n_grades - 1
    share = np.array([((grades <= k).sum() + 0.5) / (len(grades) + 1) for k in range(n_cut)])
    base = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_cut))
    model = Ordinal(np.zeros(2 * SIZE), base)
    if not len(rows):
        model.thresholds = np.arange(n_cut) - 20.0  # nothing speaks against any text
    if not len(rows) or len(np.unique(grades)) < 2:
        return model
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    held = np.bincount(at, minlength=2 * SIZE)
    keep = ((held >= min_df) & ((np.arange(2 * SIZE) < SIZE) | (held <= max(min_df, common * len(rows)))))[at]
    at, value, row = at[keep], value[keep].astype(np.float64), row[keep]
    used, at = np.unique(at, return_inverse=True)
    # thresholds as a first one and positive steps, so their order holds
    x = np.concatenate([np.zeros(len(used)), base[:1], np.log(np.maximum(np.diff(base), 1e-3))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    rows_n, d = len(rows), len(used)
    for step in range(1, steps + 1):
        w, cut = x[:d], np.cumsum(np.concatenate([x[d : d + 1], np.exp(x[d + 1 :])]))
        score = np.bincount(row, value * w[at], minlength=rows_n)
        below = np.concatenate([np.zeros((rows_n, 1)), 1 / (1 + np.exp(-np.clip(cut[None, :] - score[:, None], -40, 40))), np.ones((rows_n, 1))], axis=1)
        lo, hi = below[np.arange(rows_n), grades], below[np.arange(rows_n), grades + 1]
        p = np.maximum(hi - lo, 1e-12)
        dlo, dhi = lo * (1 - lo) / p, hi * (1 - hi) / p
        g_score = (dhi - dlo) / rows_n  # of -log p by the score
        g = np.zeros_like(x)
        g[:d] = np.bincount(at, value * g_score[row], minlength=d) + ridge * w
        g_cut = np.array([(np.where(grades == k + 1, dlo, 0) - np.where(grades == k, dhi, 0)).sum() / rows_n for k in range(n_cut)])
        g[d] = g_cut.sum()
        for k in range(1, n_cut):
            g[d + k] = g_cut[k:].sum() * np.exp(x[d + k])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights[used] = x[:d]
    model.thresholds = np.cumsum(np.concatenate([x[d : d + 1], np.exp(x[d + 1 :])]))
    return model


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null without a quality label."""
    return F.when(quality.isNull(), None).when(F.coalesce(toxic, F.lit(0)) > 0, 0).when(quality > 0, 2).otherwise(1)


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, n_grades: int = 3, min_df: int = 8, common: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """labels: (doc_id, quality, toxic). Of several labels for a doc_id the worst grade counts, of several texts the greatest."""
    graded = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(grade(F.col("quality"), F.col("toxic"))).alias("grade")).where("grade is not null")
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("grade").alias("grade"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, value = [], []
            for t in b.column("text"):
                (a, v), r = features(t.as_py()), runs(t.as_py())
                at.append(np.concatenate([a, r]).astype("<i4").tobytes())
                value.append(np.concatenate([v, np.ones(len(r))]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["doc_id", "grade", "at", "value"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 * SIZE, np.int64)
        for b in batches:
            for x in b.column("at"):
                held[np.frombuffer(x.as_py(), "<i4")] += 1  # a text has a feature once
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(held[seen])], ["feature", "n"])

    # features are counted and thinned on the executors, so the driver gets those that can have a weight
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(met.mapInArrow(run, "doc_id long, grade int, at binary, value binary"), "features")
    n = rows.count()
    counts = rows.select("at").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    allowed = np.zeros(2 * SIZE, bool)
    allowed[counts.where((F.col("n") >= min_df) & ((F.col("feature") < SIZE) | (F.col("n") <= max(min_df, common * n)))).select("feature").toArrow().column(0).to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(allowed)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = sent.value
        for b in batches:
            at, value = [], []
            for x, v in zip(b.column("at"), b.column("value"), strict=True):
                x, v = np.frombuffer(x.as_py(), "<i4"), np.frombuffer(v.as_py(), "<f4")
                at.append(x[keep[x]].tobytes())
                value.append(v[keep[x]].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["doc_id", "grade", "at", "value"])

    got = rows.mapInArrow(thin, rows.schema).toArrow().sort_by("doc_id")
    parsed = [(np.frombuffer(a.as_buffer(), "<i4"), np.frombuffer(v.as_buffer(), "<f4")) for a, v in zip(got.column("at"), got.column("value"), strict=True)]
    return fit(parsed, got.column("grade").to_numpy().astype(np.int64), n_grades, min_df, common)


def scored(docs: DataFrame, model: Ordinal, text_col: str = "text") -> Column:
    """A struct (expected_grade, p_top) of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    bound_batches(docs.sparkSession)

    @F.arrow_udf("expected_grade double, p_top double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        score = Scorer(own)
        for part in texts:
            below = own.at_most(np.array(score.many(part.to_pylist()), np.float64))
            yield pa.StructArray.from_arrays([pa.array((1 - below).sum(axis=1)), pa.array(1 - below[:, -1])], ["expected_grade", "p_top"])

    return run(F.col(text_col).cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_top, kept) of every row; kept: the tail probability P(top grade) is ``least`` or more.

    A null text is empty. Repeated rows and null ids get a row each. Without labels every text has the same score and
    stays. Other columns are not read.
    """
    model = train(docs, labels, sample, id_col=id_col, text_col=text_col)
    got = docs.select(F.col(id_col).alias("doc_id"), scored(docs, model, text_col).alias("s"))
    return got.select("doc_id", "s.expected_grade", "s.p_top", (F.col("s.p_top") >= least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = 6000) -> DataFrame:
    """The rows of docs that ``classify`` keeps, columns as they were."""
    model = train(docs, labels, sample)
    return docs.where(scored(docs, model)["p_top"] >= least)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
