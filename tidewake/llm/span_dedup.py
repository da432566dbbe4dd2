"""Substring dedup by sliding sentence spans.

A sentence ends after a run of ``.!?`` or at a line's end and takes the white space behind it along, so a text is the sum of
its sentences. From each sentence runs the shortest span forwards, and to each the shortest span backwards, that has
``sentences`` = 2 sentences or more and ``min_words`` = 20 words or more; a sentence of twice that many words is a span too.
So a repeated passage of whole sentences with that many words is covered to its first and last sentence, whatever
surrounds it. Spans are hashed (128 bits of their lower-cased words) and grouped over the corpus; the first occurrence by
(doc_id, position) stays, and sentences that any other occurrence covers go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import Scratch, row_id, table

_SENTENCE = re.compile(rb"[^.!?\n]*[.!?]*\s*")


def split_sentences(text: bytes) -> list[bytes]:
    return [s for s in _SENTENCE.findall(text) if s]


def spans(text: bytes, sentences: int = 2, min_words: int = 20) -> list[tuple[int, int, bytes]]:
    """(start, size, words) of every span of a text, each once."""
    words = [s.lower().split() for s in split_sentences(text)]
    at = [k for k, w in enumerate(words) if w]
    n, sizes = len(at), [len(words[k]) for k in at]
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    found, j = {(i, i + 1) for i in range(n) if sizes[i] >= 2 * min_words}, 0
    for i in range(n):  # forwards
        j = max(j, i + sentences)
        while j <= n and total[min(j, n)] - total[i] < min_words:
            j += 1
        if j > n:
            break
        found.add((i, j))
    i = n
    for j in range(n, 0, -1):  # backwards
        i = min(i, j - sentences)
        while i >= 0 and total[j] - total[i] < min_words:
            i -= 1
        if i < 0:
            break
        found.add((i, j))
    joined = [b" ".join(words[k]) for k in at]
    return [(at[i], at[j - 1] + 1 - at[i], b"\n".join(joined[i:j])) for i, j in sorted(found)]


def _spans(docs: DataFrame, sentences: int, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, who = ([], [], [], []), []
            for k, t in enumerate(b.column("text")):
                for start, size, words in spans(t.as_py() or b"", sentences, min_words):
                    h = xxhash.xxh3_128_digest(words)
                    out[0].append(int.from_bytes(h[:8], "little", signed=True))
                    out[1].append(int.from_bytes(h[8:], "little", signed=True))
                    out[2].append(start)
                    out[3].append(size)
                    who.append(k)
            at = pa.array(who, pa.int32())
            cols = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, b.column("doc").take(at), b.column("mark").take(at)], ["hi", "lo", "start", "size", "doc", "mark"])

    return docs.select("doc", "mark", "text").mapInArrow(run, "hi long, lo long, start int, size int, doc long, mark long")


def _cut(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, kept = [], [], []
            for t, out in zip(b.column("text"), b.column("gone"), strict=True):
                text, drop = split_sentences(t.as_py() or b""), set()
                for s in out.as_py() or ():
                    drop.update(range(s["start"], s["start"] + s["size"]))
                total.append(len(text))
                gone.append(len(drop))
                kept.append(b"".join(s for k, s in enumerate(text) if k not in drop) if drop else b"".join(text))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_sentences", "n_removed", "kept"])

    return docs.select("doc_id", F.col("text"), "gone").mapInArrow(run, "doc_id long, n_sentences long, n_removed long, kept binary")


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 2, min_words: int = 20) -> DataFrame:
    """(doc_id, n_sentences, n_removed, kept binary) of every row.

    Null and empty texts have no sentences. A null doc_id comes after every number. Rows repeated with the same doc_id and text
    count as one document: they get the same result. Other columns are not read. Texts are split into spans once, and the
    spans' hashes are written. Half a hash counts them, combined before the shuffle; only spans whose half comes again look for
    their first occurrence by the whole one. Occurrences meet the repeated spans in joins whose large partitions can be split,
    so a passage of a third of all documents needs no task of its own.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    doc = F.col(id_col).cast("long")
    # a document's mark is a hash of its row, below zero if it has a doc_id: a null comes behind the largest number
    mark = F.shiftrightunsigned(row_id(id_col, text_col)["lo"], 1) + F.when(doc.isNull(), F.lit(0)).otherwise(F.lit(-(1 << 63)))
    base = docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit((1 << 63) - 1)).alias("doc"), mark.alias("mark"), F.col(text_col).cast("binary").alias("text"))
    seen = scratch.save(_spans(base, sentences, min_words), "spans")
    again = seen.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi")
    seen = scratch.save(seen.join(again, "hi").select("hi", "lo", "start", "size", "doc", "mark"), "again")
    first = F.min(F.struct("doc", "mark", "start")).alias("first")
    # a document's own repeats differ in start; a repeated row is the same occurrence
    last = F.max(F.struct("doc", "mark", "start")).alias("last")
    repeated = scratch.save(seen.groupBy("hi", "lo").agg(first, last).where("first <> last").select("hi", "lo", "first"), "repeated")
    later = seen.join(repeated, ["hi", "lo"]).where(F.struct("doc", "mark", "start") != F.col("first"))
    gone = later.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "size")).alias("gone"))
    return _cut(base.join(scratch.save(gone, "gone"), ["doc", "mark"], "left"))


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_spans(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_sentences", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^.!?
]*[.!?]*[\x09-\x0D ]*'), lambda x: x <> '') AS s FROM documents),
w AS (SELECT doc_id, s, list_transform(s, lambda x: list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda y: y <> '')) AS ws FROM d),
f AS (SELECT doc_id, list_filter(list_zip(ws, range(len(s))), lambda p: len(p[1]) > 0) AS kept FROM w),
g AS (SELECT doc_id, list_transform(kept, lambda p: p[2]) AS pos, list_transform(kept, lambda p: array_to_string(p[1], ' ')) AS txt, list_transform(kept, lambda p: len(p[1])) AS n FROM f),
e AS (SELECT doc_id, unnest(n) AS n, generate_subscripts(n, 1) AS k FROM g),
c AS (SELECT doc_id, k, n, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto, sum(n) OVER (PARTITION BY doc_id ORDER BY k) - n AS before_ FROM e),
ends AS (SELECT a.doc_id, a.k AS i, b.k AS j FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.k BETWEEN a.k + 1 AND a.k + 19 AND b.upto - a.before_ >= 20),
runs AS (SELECT doc_id, i, min(j) AS j FROM ends GROUP BY doc_id, i UNION SELECT doc_id, max(i) AS i, j FROM ends GROUP BY doc_id, j UNION SELECT doc_id, k, k FROM c WHERE n >= 40),
t AS (SELECT r.doc_id, pos[i] AS first_, pos[j] AS last_, array_to_string(txt[i:j], chr(10)) AS txt FROM runs r JOIN g USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY txt ORDER BY doc_id, first_) AS place FROM t),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(first_, last_ + 1)))) AS gone FROM o WHERE place > 1 GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(len(gone), 0)::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(s, range(len(s))), lambda p: NOT list_contains(coalesce(gone, []), p[2])), lambda p: p[1]), ''), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
