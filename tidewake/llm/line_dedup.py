"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (hi, lo, docs) in buckets by the 128-bit hash of a line's key, each bucket sorted by it, with the number of
documents of one or more batches that hold the line. Batches come in one after another: a batch is dealt into the same
buckets and sorted, then merged with run after run as they lie, without moving or sorting these again. Lines that the runs
already settle (seen in ``min_docs`` documents or more) go, and what is left becomes a run of level 0. When a level has
``fanout`` runs they are added up into one run of the next level, so a line is in O(log batches) runs. Adding up shuffles
(hi, lo, docs) behind a partial sum, once for each level that a line passes: Spark takes a union of bucketed scans for
bucketed where it reads them by columns, while equal keys come in different tasks, so the runs are added up from their plain files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import WHITE, Scratch, lower_ascii, row_id, table


ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """Runs are bucketed tables, which only a catalog can hold; use as a context manager, so that none is left behind."""

    def __init__(self, scratch: Scratch, min_docs: int = 10, fanout: int = 3, buckets: int | None = None):
        self.scratch, self.min_docs, self.fanout = scratch, min_docs, fanout
        self.buckets = buckets or int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.made, self.name = 0, f"tidewake_runs_{uuid.uuid4().hex}"
        # one file for each bucket, written in order: scans may say so while the runs are open
        self.before = scratch.spark.conf.get(ORDERED, None)
        scratch.spark.conf.set(ORDERED, "true")

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _write(self, level: int, counts: DataFrame) -> None:
        self.made += 1
        name = f"runs/level{level}-{self.made}"
        while len(self.levels) <= level:
            self.levels.append([])
        table = f"{self.name}_{self.made}"
        dealt = counts.select("hi", "lo", "docs").repartition(self.buckets, "hi", "lo")
        dealt.write.format("parquet").bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", self.scratch.path(name)).option("compression", "zstd").mode("overwrite").saveAsTable(table)
        self.levels[level].append((name, self.scratch.spark.table(table)))

    def _drop(self, runs: list[tuple[str, DataFrame]]) -> None:
        for name, _ in runs:
            self.scratch.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{name.rsplit('-', 1)[1]}")
            self.scratch.drop(name)

    def _runs(self) -> list[DataFrame]:
        return [df for level in self.levels for _, df in level]

    def _merged(self, counts: DataFrame) -> DataFrame:
        """A batch's rows with ``held``, the documents of each line in all runs, by merging it with one run after another."""
        total = F.lit(0).cast("long")
        for k, run in enumerate(self._runs()):
            counts = counts.join(run.select("hi", "lo", F.col("docs").alias(f"_run{k}")).hint("merge"), ["hi", "lo"], "left")
            total = total + F.coalesce(f"_run{k}", F.lit(0))
        return counts.select("hi", "lo", "docs", total.alias("held"))

    def add(self, counts: DataFrame) -> None:
        """counts: (hi, lo, docs) of a new batch, a row for each line."""
        self._write(0, self._merged(counts).where(F.col("held") < self.min_docs))
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(level + 1, self._sum(full))
            self._drop(full)
            level += 1

    def new_lines(self, counts: DataFrame) -> DataFrame:
        """The lines of a batch that no run has: those that an incremental first-seen dedup keeps."""
        return self._merged(counts).where("held = 0").select("hi", "lo", "docs")

    def repeated(self) -> DataFrame:
        """(hi, lo) of lines in min_docs documents or more."""
        if not self.made:
            raise ValueError("no batch was added")
        return self._sum([run for level in self.levels for run in level]).where(F.col("docs") >= self.min_docs).select("hi", "lo")

    def _sum(self, runs: list[tuple[str, DataFrame]]) -> DataFrame:
        """The documents of each line over runs."""
        files = self.scratch.spark.read.schema("hi long, lo long, docs long").parquet(*[self.scratch.path(name) for name, _ in runs])
        return files.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"))

    def close(self) -> None:
        """Drop all runs, and leave the session as it was; what was read from them must be written by then."""
        for level in self.levels:
            self._drop(level)
        self.levels = []
        if self.before is None:
            self.scratch.spark.conf.unset(ORDERED)
        else:
            self.scratch.spark.conf.set(ORDERED, self.before)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def _hash_of(key: Column, min_chars: int) -> Column:
    """The key's hash, null for a key of fewer code points."""
    return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("hi"), F.xxhash64(F.lit("line"), key).alias("lo")))


def _hashed(lines: Column, min_chars: int, distinct: bool = False) -> Column:
    """The hash of each line's key; distinct: each key once (as strings, which Spark finds in a hash set)."""
    keys = F.transform(lines, line_key)
    return F.transform(F.array_distinct(keys) if distinct else keys, lambda k: _hash_of(k, min_chars))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): texts without the lines whose key is in min_docs documents or more.

    A document is a row: a repeated row counts again, and a line repeated in a row counts once. A null or empty text is one
    empty line. A null doc_id is a document like any other. Rows are dealt into batches by their hash. Keys shuffle as 16-byte
    hashes, counted before the shuffle, so a line of a third of all documents is one row from each task; texts move once, to
    meet the list of their lines that go.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row_id(id_col, text_col).alias("rid"))
    lines = F.split("text", "\n", -1)
    held = base.select("rid", _hashed(lines, min_chars, distinct=True).alias("h")).select("rid", F.explode("h").alias("h")).where("h is not null")
    held = scratch.save(held.select("rid", "h.hi", "h.lo", F.pmod(F.col("rid.hi"), F.lit(batches)).cast("int").alias("batch")), "held")
    counts = scratch.save(held.groupBy("batch", "hi", "lo").agg(F.count("*").alias("docs")), "counts")
    with LineRuns(scratch, min_docs) as runs:
        for k in range(batches):
            runs.add(counts.where(F.col("batch") == k).select("hi", "lo", "docs"))
        repeated = scratch.save(runs.repeated(), "repeated")
    gone = held.join(repeated, ["hi", "lo"]).groupBy("rid").agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))
    gone = scratch.save(gone, "gone")
    met = base.join(gone, "rid", "left").select("doc_id", lines.alias("lines"), "gone")
    # long lists of lines that go are looked up by parts of their hash, so that a text of many such lines stays linear
    parts = F.when(F.size("gone") > 64, 256).otherwise(1)
    split = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.filter("gone", lambda g: F.pmod(g["hi"], parts) == k))
    marked = met.select("doc_id", F.size("lines").cast("long").alias("n_lines"), "lines", F.when(F.col("gone").isNotNull(), _hashed(F.col("lines"), min_chars)).alias("h"), F.when(F.col("gone").isNotNull(), split).alias("gone"))

    def goes(h: Column) -> Column:
        own = F.element_at("gone", (F.pmod(h["hi"], F.size("gone")) + 1).cast("int"))
        return F.coalesce(F.array_contains(own, h), F.lit(False))

    stay = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~goes(F.element_at("h", i + 1))))
    kept = marked.select("doc_id", "n_lines", stay.alias("kept"))
    return kept.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT r, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE hot.key IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY r, doc_id
"""
