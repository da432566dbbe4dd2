"""Places and neighbours in the order of a whole table, without one task that orders it.

Rows are dealt by ranges of (by, order) and written, sorted, part after part. A part's edges (how many rows of each group it
has, and its first one) are a small table: their running sum is where each part's rows start, and the first row of the next
part is the neighbour of the last one of this part. Only edges, a row for each part and group in it, meet in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.shared import Scratch, fresh


@dataclass
class LaidOut:
    """rows: the table with the columns ``part`` and ``row``, ascending in order. edges: (by..., part, n, start, first), ``start`` the
    place in the group of the part's first row, ``first`` that row's ``row``, ``every`` the group's rows. Column names of these are
    in ``names``, changed where the table has them already."""

    rows: DataFrame
    edges: DataFrame
    by: list[str]
    names: dict[str, str]

    def _met(self, edges: DataFrame) -> DataFrame:
        """The rows with their edge's columns: of one group and part, so no key has more rows than a part."""
        part = self.names["part"]
        same = [F.col(f"l.{part}") == F.col(f"r.{part}"), *[F.col(f"l.`{b}`").eqNullSafe(F.col(f"r.`{b}`")) for b in self.by]]
        more = [c for c in edges.columns if c not in (part, *self.by)]
        return self.rows.alias("l").join(edges.alias("r"), same).select(*[F.col(f"l.`{c}`") for c in self.rows.columns], *[F.col(f"r.`{c}`") for c in more])

    def places(self, edges: DataFrame | None = None, name: str = "place") -> DataFrame:
        """The rows with ``name``, from 0 in each group. edges: those of this table with more columns, which the rows get too."""
        n = self.names
        met = self._met(self.edges if edges is None else edges)
        return met.withColumn(name, F.col(n["start"]) + F.col(n["row"]) - F.col(n["first"])).drop(*[n[c] for c in ("part", "row", "n", "start", "first", "every") if n[c] in met.columns])

    def lead(self, column: str, name: str) -> DataFrame:
        """The rows with ``name``, the column's value in the next row of the group, null on its last one."""
        n, by = self.names, [F.col(f"`{b}`") for b in self.by]
        part, row = n["part"], n["row"]
        heads = self.rows.groupBy(*by, part).agg(F.min_by(F.struct(F.col(f"`{column}`").alias("v")), row).alias("head"))
        after = W.partitionBy(*by).orderBy(part)  # over edges
        stitched = heads.withColumn("next_head", F.lead("head").over(after)).drop("head")
        within = LaidOut(self.rows.withColumn(name, F.lead(F.struct(F.col(f"`{column}`").alias("v"))).over(W.partitionBy(*by, part).orderBy(row))), self.edges, self.by, n)
        met = within._met(stitched)
        return met.withColumn(name, F.coalesce(name, "next_head")["v"]).drop("next_head", part, row)


def laid_out(df: DataFrame, order: list[str | Column], by: list[str] | None = None, scratch: Scratch | None = None, name: str = "laid_out") -> LaidOut:
    """The table in order within each group of ``by`` (without: as one), written to the shared folder.

    Groups compare nulls as equal; nulls come first. Rows that tie in ``order`` come in some order, which stays. A group, or a
    null, of a third of all rows is cut into parts by ``order`` like the rest; rows alike in all of ``by`` and ``order`` share a part.
    """
    by = list(by or [])
    scratch = scratch or Scratch(df.sparkSession, "numbering")
    names = {c: fresh(df, f"_{c}") for c in ("part", "row", "n", "start", "first", "every")}
    keys = [*[F.col(f"`{b}`") for b in by], *order]
    part, row = names["part"], names["row"]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(row, F.monotonically_increasing_id())
    rows = scratch.save(dealt.withColumn(part, F.shiftright(row, 33).cast("int")), name)
    cols = [F.col(f"`{b}`") for b in by]
    edges = rows.groupBy(*cols, part).agg(F.count("*").alias(names["n"]), F.min(row).alias(names["first"]))
    whole = W.partitionBy(*cols)  # over edges
    upto = whole.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.withColumns({names["start"]: F.coalesce(F.sum(names["n"]).over(upto), F.lit(0)), names["every"]: F.sum(names["n"]).over(whole)})
    return LaidOut(rows, scratch.save(edges, f"{name}_edges"), by, names)


def numbered(df: DataFrame, order: list[str | Column], by: list[str] | None = None, name: str = "place") -> DataFrame:
    """The table with ``name``, each row's place in its group, from 0."""
    return laid_out(df, order, by).places(name=name)


def with_next(df: DataFrame, column: str, order: list[str | Column], name: str, by: list[str] | None = None) -> DataFrame:
    """The table with ``name``, the column's value in the next row of the group."""
    return laid_out(df, order, by).lead(column, name)
