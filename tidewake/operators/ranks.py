"""Exact percentiles of groups without a bound: a sketch brackets each rank, and only the bracket's values are counted.

The built-in exact percentile keeps a map of a group's distinct values in one task, which a grand total over all rows outgrows.
A table of up to WHOLE rows, counted beforehand, has no such group: there the built-in one serves all grouping sets in one
aggregation. Beyond, the values are written once. One aggregation takes each group's count, ends and a quantile sketch of fixed
size, whose answers a few ranks to both sides are the first bracket. A pass then counts each bracket's rows and those below: a
bracket that misses its rank is widened, one of more than BOUND rows is narrowed by cuts of its own values, and again until
each holds its rank and few enough values. Last, these values are counted and the rank is found among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.shared import Scratch

#: The sketch's relative error is 1 / ACCURACY; tables of up to WHOLE rows need none; brackets hold BOUND rows or two values.
ACCURACY, WHOLE, BOUND = 100_000, 1_000_000, 100_000
#: Cuts of a bracket that is too wide, and rounds after which something is wrong.
CUTS, ROUNDS = 256, 16


def _brackets(base: DataFrame, keys: list[str], wanted: list[tuple[str, float]], accuracy: int, bound: int, scratch: Scratch) -> DataFrame:
    """(keys..., b0, b1, ...) with a verified bracket (i, p, n, low, high) for each wanted column and share."""
    struct = lambda i, p, n, low, high: F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), n.alias("n"), low.alias("low"), high.alias("high"))
    cols = []
    for i, (c, p) in enumerate(wanted):
        v = F.col(c)
        near = F.percentile_approx(v, F.array(F.lit(max(0.0, p - 4 / accuracy)), F.lit(min(1.0, p + 4 / accuracy))), accuracy)
        low, high = F.when(F.lit(p <= 4 / accuracy), F.min(v)).otherwise(near[0]), F.when(F.lit(p >= 1 - 4 / accuracy), F.max(v)).otherwise(near[1])
        cols += [struct(i, p, F.count(v), low, high).alias(f"b{i}"), F.struct(F.min(v).alias("min"), F.max(v).alias("max")).alias(f"e{i}")]
    found = scratch.save(base.groupBy(*keys).agg(*cols), "brackets0")
    for turn in range(1, ROUNDS + 1):
        met = _met(base, found, keys, wanted)
        made = []
        for i, (c, _) in enumerate(wanted):
            v, b = F.col(c), F.col(f"b{i}")
            inside = F.when(v.between(b["low"], b["high"]), v)
            cuts = F.percentile_approx(inside, F.array(*[F.lit(k / CUTS) for k in range(CUTS + 1)]), 20 * CUTS)
            made += [F.first(b).alias(f"b{i}"), F.first(f"e{i}").alias(f"e{i}"), F.struct(
                F.count_if(v < b["low"]).alias("below"), F.count(inside).alias("within"), F.count_if(v == b["low"]).alias("lows"), F.count_if(v == b["high"]).alias("highs"),
                F.min(F.when(v > b["low"], v)).alias("next"), F.max(F.when(v < b["high"], v)).alias("prev"), cuts.alias("cuts")).alias(f"c{i}")]
        counted = scratch.save(met.groupBy(*keys).agg(*made), f"counted{turn}")
        done, new = F.lit(True), []
        for i in range(len(wanted)):
            b, e, c = F.col(f"b{i}"), F.col(f"e{i}"), F.col(f"c{i}")
            first = F.floor(b["p"] * (b["n"] - 1))
            second = F.least(first + 1, b["n"] - 1)
            holds = (c["below"] <= first) & (second < c["below"] + c["within"])
            few = (c["within"] <= bound) | (b["low"] >= b["high"]) | (c["next"] >= b["high"])
            ok = (b["n"] == 0) | (holds & few)
            part = lambda k: F.floor((k - c["below"]) * CUTS / c["within"])  # noqa: B023,E731
            low, high = F.get(c["cuts"], F.greatest(F.lit(0), part(first) - 2).cast("int")), F.get(c["cuts"], F.least(F.lit(CUTS), part(second) + 3).cast("int"))
            # where the ends themselves are most of the bracket, its ranks lie on them or strictly between
            same = (low == b["low"]) & (high == b["high"])
            on_low, on_high = first < c["below"] + c["lows"], second >= c["below"] + c["within"] - c["highs"]
            low, high = F.when(same & ~on_low, c["next"]).otherwise(low), F.when(same & ~on_high, c["prev"]).otherwise(high)
            low, high = F.when(same & on_high & ~on_low, c["prev"]).otherwise(low), F.when(same & on_low, c["next"]).otherwise(high)
            narrow = F.struct(b["i"].alias("i"), b["p"].alias("p"), b["n"].alias("n"), F.when(holds, low).otherwise(e["min"]).alias("low"), F.when(holds, high).otherwise(e["max"]).alias("high"))
            new += [F.when(ok, b).otherwise(narrow).alias(f"b{i}"), e.alias(f"e{i}")]
            done = done & ok
        if counted.where(~done).isEmpty():
            return counted.select(*keys, *[f"b{i}" for i in range(len(wanted))])
        found = scratch.save(counted.select(*keys, *new), f"brackets{turn}")
    raise RuntimeError(f"ranks aren't bracketed after {ROUNDS} rounds")


def _met(base: DataFrame, found: DataFrame, keys: list[str], wanted: list[tuple[str, float]]) -> DataFrame:
    """The rows with their group's brackets."""
    more = [c for c in found.columns if c not in keys]
    if not keys:
        return base.withColumn("_f", found.select(F.struct(*more)).scalar()).select(*base.columns, *[F.col("_f")[c].alias(c) for c in more])
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return base.alias("l").join(found.alias("r"), same).select(*[F.col(f"l.{c}") for c in base.columns], *[F.col(f"r.{c}") for c in more])


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], accuracy: int = ACCURACY, bound: int = BOUND) -> DataFrame:
    """(by..., a column for each name): linearly interpolated percentiles of columns, nulls left out; null without values.

    wanted: name -> (column, share from 0 to 1). Groups compare nulls as equal. Every group of df has a row. df is read once; its
    keys and values are written and read again for each pass.
    """
    scratch = Scratch(df.sparkSession, "ranks")
    keys, names = [f"_by{k}" for k in range(len(by))], list(wanted)
    columns: dict[str, str] = {}  # a column that several percentiles are of is written once
    values = []
    for n in names:
        text = str(wanted[n][0])
        if text not in columns:
            columns[text] = f"_v{len(columns)}"
            values.append(wanted[n][0].cast("double").alias(columns[text]))
    base = scratch.save(df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], *values), "base")
    own = [(columns[str(wanted[n][0])], wanted[n][1]) for n in names]
    brackets = _brackets(base, keys, own, accuracy, bound, scratch)
    met = _met(base, brackets, keys, own)
    pairs = [F.struct(F.col(f"b{i}").alias("b"), F.col(c).alias("v")) for i, (c, _) in enumerate(own)]
    long = met.select(*keys, F.explode(F.filter(F.array(*pairs), lambda z: z["v"] <= z["b"]["high"])).alias("z"))
    # rows below the bracket count under a null value
    value = F.when(F.col("z.v") >= F.col("z.b.low"), F.col("z.v"))
    counts = long.groupBy(*keys, F.col("z.b.i").alias("i"), value.alias("v")).agg(F.count("*").alias("c"), F.first("z.b.n").alias("n"), F.first("z.b.p").alias("p"))
    upto = F.sum("c").over(W.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, 0))
    place = F.col("p") * (F.col("n") - 1)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    ranked = counts.withColumn("upto", upto).groupBy(*keys, "i").agg(at(F.floor(place)).alias("a"), at(F.floor(place) + 1).alias("b"), F.max(place - F.floor(place)).alias("part"))
    exact = F.col("a") + F.coalesce((F.col("b") - F.col("a")) * F.col("part"), F.lit(0.0))
    made = ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, exact)).alias(n) for i, n in enumerate(names)])
    if not keys:
        return made
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    out = brackets.select(*keys).alias("g").join(made.alias("m"), same, "left")
    return out.select(*[F.col(f"g.{k}").alias(b) for b, k in zip(by, keys, strict=True)], *[F.col(f"m.{n}").alias(n) for n in names])


def with_quantiles(df: DataFrame, by: list[str], aggregates: dict[str, Column], wanted: dict[str, tuple[Column, float]], sets: list[list[str]] | None = None) -> DataFrame:
    """One row for each group with its aggregates and exact percentiles. sets: grouping sets over ``by``; without, by alone."""
    sets, rows = sets if sets is not None else [by], df.count()
    columns = [*by, *aggregates, *wanted]
    if not rows:  # a grand total has a row all the same
        parts = [df.groupBy(*own).agg(*[c.alias(n) for n, c in aggregates.items()], *[F.lit(None).cast("double").alias(n) for n in wanted]) for own in sets]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns])
    if rows <= WHOLE:
        shares: dict[str, list[str]] = {}
        for n, (c, _) in wanted.items():
            shares.setdefault(str(c), []).append(n)
        lists = {f"_q{k}": (own, F.percentile(wanted[own[0]][0].cast("double"), F.array(*[F.lit(float(wanted[n][1])) for n in own]))) for k, own in enumerate(shares.values())}
        grouped = df.groupBy(*sets[0]) if len(sets) == 1 else df.groupingSets(sets, *by)
        got = grouped.agg(*[c.alias(n) for n, c in aggregates.items()], *[c.alias(q) for q, (_, c) in lists.items()])
        exact = {n: F.get(q, F.lit(k)).alias(n) for q, (own, _) in lists.items() for k, n in enumerate(own)}
        missing = {b: F.lit(None).cast(df.schema[b].dataType).alias(b) for b in by if len(sets) == 1 and b not in sets[0]}
        return got.select(*[missing.get(b, F.col(b)) for b in by], *aggregates, *[exact[n] for n in wanted])
    every = F.array(*[F.struct(F.lit(k).alias("_set"), *[(F.col(b) if b in own else F.lit(None).cast(df.schema[b].dataType)).alias(b) for b in by]) for k, own in enumerate(sets)])
    wide = df.withColumn("_z", F.explode(every)).drop(*by).select("*", "_z.*").drop("_z")  # a row for each set, all sets in each pass
    got, exact = wide.groupBy("_set", *by).agg(*[c.alias(n) for n, c in aggregates.items()]), quantiles(wide, ["_set", *by], wanted)
    same = [F.col(f"a.{b}").eqNullSafe(F.col(f"q.{b}")) for b in ("_set", *by)]
    return got.alias("a").join(exact.alias("q"), same, "left").select(*[F.col(f"a.{b}").alias(b) for b in (*by, *aggregates)], *[F.col(f"q.{n}").alias(n) for n in wanted])
