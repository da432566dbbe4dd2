"""Toxicity: maximum-scoring segments of token log-odds, with their significance by extreme values.

Learning. Labelled rows tell, for each token, how many toxic and how many clean texts hold it. A token is a word, stripped of
marks and in lower case, or a run of GRAM bytes of a framed word, which speaks for words that were never seen; both are
hashed, so the counts have a fixed size whatever the vocabulary. Its log-odds have a Dirichlet prior: pseudo-texts at the
token's rate in all labelled texts, as many as ``prior`` times these. ``z`` standard errors are taken off towards zero, so
that what is rare or even says nothing.

Scanning. A word scores its own log-odds, or the largest of its runs where it has none, less ``drift``; a telling word that was
there less than ``again`` words before says nothing new and costs the drift, as texts were counted once for each token. Ruzzo and Tompa's scan
finds all maximal scoring segments of a text in linear time: passages that no longer or shorter one beats.

Calibrating. By Karlin and Altschul the largest score of a clean text of m words is beyond s with probability
1 - exp(-K m exp(-lambda s)). Lambda and K are fitted on clean labelled texts whose tokens were not counted. A segment is
significant if fewer than ``expect`` as good ones are expected in a clean text of that length; a text's evidence takes its
best segments together by their sum statistic; a logistic curve through labelled texts makes it a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import Scratch, bound_batches, table

#: Words are hashed to the first SIZE numbers, runs of bytes to the second.
BITS, GRAM = 20, 5
SIZE = 1 << BITS
#: Words that a worker remembers, and the longest of these.
KNOWN, KNOWN_BYTES = 200_000, 64
_MARKS = b" \t\n\r\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_SEGMENTS = "array<struct<first: int, last: int, score: double>>"
_ARROW_SEGMENTS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
#: Bins of evidence and of scores that the driver gets for calibration.
EVIDENCE_BINS, SCORE_BINS = 2000, 1000


@dataclass(frozen=True)
class Settings:
    prior: float = 0.1
    z: float = 1.0
    drift: float = 0.5
    again: int = 50
    expect: float = 0.05


@dataclass(frozen=True)
class Calibration:
    """lambda and K of clean texts' largest scores, and the logistic curve over log(1 + evidence)."""

    rate: float
    k: float
    intercept: float
    slope: float


def cores(text: bytes | None) -> list[bytes]:
    """The words of a text, one for each run of what isn't white space; a run of marks alone is an empty word."""
    return [w.strip(_MARKS) for w in (text or b"").lower().split()]


def _word_numbers(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) & (SIZE - 1) for w in words), np.int64, len(words))


def _gram_numbers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of GRAM bytes of words in a frame of blanks, and where each word's runs begin; a short word is a run itself."""
    framed = [b" %s " % w if len(w) + 2 >= GRAM else b" %s" % w + b" " * (GRAM - 1 - len(w)) for w in words]
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    b = np.frombuffer(b"".join(framed) + b" " * GRAM, np.uint8).astype(np.uint64)
    code = np.zeros(len(b) - GRAM, np.uint64)
    for k in range(GRAM):
        code = code * np.uint64(257) + b[k : k + len(code)]
    counts = sizes - GRAM + 1
    ends = np.cumsum(counts)
    starts = ends - counts
    # the places of each word's runs among all bytes: its own first byte on
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(np.cumsum(sizes) - sizes - starts, counts)
    numbers = (code[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    return numbers.astype(np.int64) + SIZE, starts


def tokens(text: bytes | None) -> np.ndarray:
    """The numbers of a text's words and runs, each once."""
    words = [w for w in set(cores(text)) if w]
    if not words:
        return np.zeros(0, np.int64)
    return np.unique(np.concatenate([_word_numbers(words), _gram_numbers(words)[0]]))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), after Ruzzo and Tompa: in linear time.

    A segment is maximal if all its own parts score less and no segment around it has that property. Neighbours of one
    sign count as one step. Each candidate keeps the sums before and up to its end and a link to the nearest candidate
    before it that begins lower.
    """
    if not len(scores):
        return []
    change = np.flatnonzero(np.diff(scores > 0)) + 1
    begins = np.concatenate([[0], change])
    upto = np.cumsum(np.add.reduceat(scores, begins))
    sums = np.concatenate([[0.0], upto])
    ends = np.concatenate([change, [len(scores)]])
    found: list[list] = []  # first, last, sum before, sum at its end, link
    for k in np.flatnonzero(scores[begins] > 0).tolist():
        new = [int(begins[k]), int(ends[k]) - 1, float(sums[k]), float(sums[k + 1]), len(found) - 1]
        while True:
            j = new[4]
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            # from the start of j on it scores more
            new[0], new[2], new[4] = found[j][0], found[j][2], found[j][4]
            del found[j:]
    return [(a, b, r - left) for a, b, left, r, _ in found]


class Scanner:
    """Segments of texts under the log-odds of tokens; words are remembered, new ones of a batch are worked out together."""

    def __init__(self, odds: np.ndarray, settings: Settings = Settings()):
        self.odds, self.drift, self.again = odds, settings.drift, settings.again
        self.known: dict[bytes, float] = {}

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        own = self.odds[_word_numbers(words)].astype(np.float64)
        runs, starts = _gram_numbers(words)
        parts = np.maximum.reduceat(np.maximum(self.odds[runs], 0), starts) if len(words) else np.zeros(0)
        empty = np.fromiter((not w for w in words), bool, len(words))
        return np.where(empty, 0.0, np.where(own != 0, own, parts)) - self.drift

    def _scores(self, words: list[bytes]) -> np.ndarray:
        scores = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        seen: dict[bytes, int] = {}
        for k in np.flatnonzero(scores > 0).tolist():
            if k - seen.get(words[k], -self.again) < self.again:
                scores[k] = -self.drift
            seen[words[k]] = k
        return scores

    def many(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """(words, segments) of each text."""
        split = [cores(t) for t in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        new = list(set().union(*map(set, split)).difference(self.known))
        self.known.update(zip(new, self.word_scores(new).tolist(), strict=True))
        out = [(len(words), segments(self._scores(words))) for words in split]
        for w in new:
            if len(w) > KNOWN_BYTES:
                del self.known[w]
        return out


def labelled(labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, toxic boolean), a row for each id with a label: of several any that says toxic counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label) > 0).alias("toxic"))


def fold(doc_id: Column) -> Column:
    """0 to 4 by crc32 of the id as text; null ids are in none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def log_odds(texts: DataFrame, settings: Settings) -> np.ndarray:
    """The score of each token number. texts: (toxic boolean, text binary), each row counted, whole.

    A task adds up its texts in one array, so what moves is at most 2 * SIZE numbers from each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 2 * SIZE + 1), np.int64)  # the last number: the texts themselves
        for b in batches:
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                held[int(toxic), tokens(text)] += 1
                held[int(toxic), -1] += 1
        seen = np.flatnonzero(held.any(axis=0))
        for k in range(0, len(seen), 100_000):
            own = seen[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(held[1, own]), pa.array(held[0, own])], ["token", "toxic", "clean"])

    counts = Scratch(texts.sparkSession, "toxicity").save(texts.mapInArrow(count, "token int, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "counts")
    odds = np.zeros(2 * SIZE, np.float32)
    all_ = counts.where(F.col("token") == 2 * SIZE).first()
    if all_ is None or not all_["toxic"] or not all_["clean"]:
        return odds
    nt, nc = float(all_["toxic"]), float(all_["clean"])
    extra = settings.prior * (nt + nc)
    own = F.lit(settings.prior) * (F.col("toxic") + F.col("clean"))  # pseudo-texts with the token
    t, c = F.col("toxic") + own, F.col("clean") + own
    delta = F.log(t / (nt + extra)) - F.log(c / (nc + extra))
    error = settings.z * F.sqrt(1 / t + 1 / c)
    score = F.signum(delta) * F.greatest(F.abs(delta) - error, F.lit(0.0))
    got = counts.where(F.col("token") < 2 * SIZE).select("token", score.cast("float").alias("score")).where("score <> 0").toArrow()  # a bounded number of tokens
    odds[got.column("token").to_numpy()] = got.column("score").to_numpy()
    return odds


def fit_extremes(score: np.ndarray, words: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and K of n texts each with their largest score (0: none) and number of words, by maximum likelihood.

    For a given lambda the best K is known; lambda is found by halving an interval of its logarithm by the golden section.
    """
    if not n.sum() or not (n * (score > 0)).sum():
        return 1.0, 1.0 / (1.0 + float((n * words).sum()))
    hits = (n * (score > 0)).sum()

    def k_of(rate: float) -> float:
        return float(hits / (n * words * np.exp(-rate * score)).sum())

    def loss(log_rate: float) -> float:
        rate = math.exp(log_rate)
        k = k_of(rate)
        return float(-(hits * math.log(k * rate) - (n * rate * score).sum() - k * (n * words * np.exp(-rate * score)).sum()))

    low, high, golden = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    rate = math.exp((low + high) / 2)
    return rate, k_of(rate)


def evidence(scores: list[float], words: int, rate: float, k: float) -> float:
    """-log of the probability that a clean text of that length has segments as good: of its best r together, for the r that says most."""
    if not scores or not words:
        return 0.0
    x = rate * np.sort(np.array(scores))[::-1] - math.log(k * words)
    single = -math.log(-math.expm1(-math.exp(-min(x[0], 30.0)))) if x[0] < 30 else float(x[0])
    x = x[x > 0]
    if len(x) < 2:
        return max(single, 0.0)
    r, total = np.arange(1, len(x) + 1), np.cumsum(x)
    factorials = np.cumsum(np.log(r))
    # P(sum of r normalised scores >= T) is near exp(-T) T^(r-1) / (r! (r-1)!), where T is large
    sums = total - (r - 1) * np.log(total) + factorials + factorials - np.log(r)
    good = total > r * (r + 1)
    return float(max(single, 0.0, sums[good].max() if good.any() else 0.0))


def fit_logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Intercept and slope of weighted counts, by Newton's method with a slight ridge on the slope; without labels the curve is far below a half."""
    total = toxic.sum() + clean.sum()
    if not total:
        return -20.0, 0.0
    share = (toxic.sum() + 0.5) / (total + 1.0)
    a, b = math.log(share / (1 - share)), 0.0
    if not toxic.sum() or not clean.sum():
        return a, b
    n = toxic + clean

    def loss(a: float, b: float) -> float:
        z = a + b * x
        return float((n * np.logaddexp(0, z) - toxic * z).sum() + ridge / 2 * (b * b + 0.01 * a * a))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        g = np.array([(n * p - toxic).sum() + 0.01 * ridge * a, ((n * p - toxic) * x).sum() + ridge * b])
        w = n * p * (1 - p)
        h = np.array([[w.sum() + 0.01 * ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() * size < 1e-9:
            break
    return float(a), float(max(b, 0.0))


def scan(docs: DataFrame, odds: np.ndarray, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, segments) of every whole text; first and last are numbers of words from 0."""
    sent = docs.sparkSession.sparkContext.broadcast(odds)  # 2 * SIZE numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(sent.value, settings)
        for b in batches:
            got = own.many(b.column("text").to_pylist())
            found = [[{"first": a, "last": z, "score": s} for a, z, s in segs] for _, segs in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array(found, _ARROW_SEGMENTS)], ["doc_id", "words", "segments"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, words long, segments {_SEGMENTS}")


def _weighed(scanned: DataFrame, rate: float, k: float) -> DataFrame:
    """The scanned rows with their evidence."""

    @F.arrow_udf("double")
    def weigh(words: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([evidence(s, n, rate, k) for s, n in zip(found.to_pylist(), words.to_pylist(), strict=True)], pa.float64())

    return scanned.withColumn("evidence", weigh("words", F.col("segments.score")))


def calibrate(scanned: DataFrame, known: DataFrame) -> Calibration:
    """scanned: rows of ``scan``. known: (doc_id, toxic) of labelled rows that were not counted. All of these count, as bins."""
    met = scanned.join(known, "doc_id")
    best = F.coalesce(F.array_max("segments.score"), F.lit(0.0))
    # scores in bins of an eighth, the last one open; words in bins by their logarithm
    bins = met.where("not toxic and words > 0").groupBy(F.least(F.floor(best * 8), F.lit(SCORE_BINS)).alias("s"), F.floor(F.log2("words") * 4).alias("m")).agg(F.count("*").alias("n"), F.avg(best).alias("score"), F.avg("words").alias("words")).toArrow()
    rate, k = fit_extremes(*[bins.column(c).to_numpy().astype(np.float64) for c in ("score", "words", "n")])
    curve = _weighed(met, rate, k).groupBy(F.least(F.floor(F.log1p("evidence") * 200), F.lit(EVIDENCE_BINS)).alias("e")).agg(F.avg(F.log1p("evidence")).alias("x"), F.sum(F.col("toxic").cast("long")).alias("toxic"), F.sum((~F.col("toxic")).cast("long")).alias("clean")).toArrow()
    intercept, slope = fit_logistic(*[curve.column(c).to_numpy().astype(np.float64) for c in ("x", "toxic", "clean")])
    return Calibration(rate, k, intercept, slope)


def detect(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, score, passages) of every row: the probability that it is toxic, and its significant passages as
    (first, last, score, expected), words from 0 and the number of as good ones expected in a clean text of that length.

    labels: (doc_id, toxic). Tokens are counted on the labelled rows of folds 1 to 3, curves fitted on those of fold 4; fold 0 isn't
    learned from. A null text is empty, without segments; repeated rows and null ids get a row each, of several texts of a labelled id each
    counts. Without labels of both kinds no token scores and all texts have the labels' share as score, 0 without any label.
    Texts of the counted rows shuffle once to meet their labels; everything later moves ids and segments.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "toxicity")
    known = labelled(labels)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    counted = texts.where(fold(F.col("doc_id")).between(1, 3)).join(known.hint("shuffle_hash"), "doc_id").select("toxic", "text")
    odds = log_odds(counted, settings)
    scanned = scratch.save(scan(docs, odds, settings, id_col, text_col), "scanned")
    curve = calibrate(scanned, known.where(fold(F.col("doc_id")) == 4))
    score = 1 / (1 + F.exp(-(F.lit(curve.intercept) + curve.slope * F.log1p("evidence"))))
    expected = lambda s: F.lit(curve.k) * F.col("words") * F.exp(-curve.rate * s["score"])
    good = F.filter(F.transform("segments", lambda s: F.struct(s["first"], s["last"], s["score"], expected(s).alias("expected"))), lambda s: s["expected"] < settings.expect)
    return _weighed(scanned, curve.rate, curve.k).select("doc_id", "words", score.alias("score"), good.alias("passages"))


def passage_texts(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first, last, score, expected, passage): each significant passage of ``detect`` as it stands in its text; ids must be unique."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array, passages: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), passages.to_pylist(), strict=True):
            at = [m.span() for m in _WORD.finditer(text or b"")]
            out.append([text[at[p["first"]][0] : at[p["last"]][1]].decode("utf-8", "replace") for p in own])
        return pa.array(out, pa.list_(pa.string()))

    marked = found.where(F.size("passages") > 0).select("doc_id", "passages")
    met = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(marked, "doc_id")
    return met.select("doc_id", F.explode(F.arrays_zip("passages", cut("text", "passages").alias("passage"))).alias("z")).select("doc_id", "z.passages.*", "z.passage")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
