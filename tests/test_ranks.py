"""Exact percentiles of large groups against the built-in ones, and plans without a percentile over groups that have no bound."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewake.operators import ranks
from tidewake.plans import diel, windows


def plain(df, by, shares):
    return {tuple(r[b] for b in by): [r[f"q{k}"] for k in range(len(shares))] for r in df.groupBy(*by).agg(*[F.percentile("v", F.lit(p)).alias(f"q{k}") for k, p in enumerate(shares)]).collect()}


@pytest.mark.parametrize("bound, accuracy", [(100_000, 100_000), (300, 200), (40, 10)])
def test_percentiles_are_exact(spark, bound, accuracy):
    """Brackets of good and of coarse sketches, wide ones and missed ones; skewed values, ties, nulls and a null group among them."""
    df = spark.range(20_000).select(F.when(F.col("id") % 5 != 4, F.col("id") % 5).alias("g"), F.when(F.col("id") % 11 != 0, F.exp(F.col("id") % 97 / 9.0) * (F.xxhash64("id") % 1000)).alias("v"))
    df = df.union(spark.range(3000).select(F.lit(7).alias("g"), F.lit(1.5).alias("v"))).union(spark.createDataFrame([(8, None), (9, 2.0), (9, None)], df.schema))
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = ranks.quantiles(df, ["g"], {f"q{k}": (F.col("v"), p) for k, p in enumerate(shares)}, accuracy, bound)
    want = plain(df, ["g"], shares)
    mine = {(r["g"],): [r[f"q{k}"] for k in range(len(shares))] for r in got.collect()}
    assert set(mine) == set(want) and len(mine) == 8
    for g, values in want.items():
        assert mine[g] == [v if v is None else pytest.approx(v, rel=1e-12) for v in values]
    every = ranks.quantiles(df, [], {f"q{k}": (F.col("v"), p) for k, p in enumerate(shares)}, accuracy, bound).first()
    assert [every[f"q{k}"] for k in range(len(shares))] == pytest.approx(plain(df, [], shares)[()])


def test_no_rows(spark):
    df = spark.createDataFrame([], "g int, v double")
    assert ranks.quantiles(df, ["g"], {"m": (F.col("v"), 0.5)}).collect() == []
    assert ranks.quantiles(df, [], {"m": (F.col("v"), 0.5)}).first()["m"] is None


UNBOUNDED = {"diel_day_night": diel.day_night, "describe_prices": windows.describe_prices, "integrated_sections": windows.integrated, "integrated_root_rollup": windows.root_rollup, "order_rollup": windows.order_rollup}


def test_heavy_ties_are_narrowed_to_their_ends(spark):
    """Two values of nearly all rows, some between: no cut of the bracket parts these, its ends do."""
    v = F.when(F.col("id") < 9000, 0.0).when(F.col("id") < 9300, F.col("id") / 10_000.0).otherwise(1.0)
    df = spark.range(18_300).select(v.alias("v"))
    shares = [0.3, 9000 / 18_299, 0.495, 9299 / 18_299, 0.51, 0.9]
    got = ranks.quantiles(df, [], {f"q{k}": (F.col("v"), p) for k, p in enumerate(shares)}, 10, 20).first()
    assert [got[f"q{k}"] for k in range(len(shares))] == pytest.approx(plain(df, [], shares)[()])


@pytest.mark.parametrize("whole", [1_000_000, 10])
def test_grouping_sets_of_small_and_large_tables(spark, monkeypatch, whole):
    monkeypatch.setattr(ranks, "WHOLE", whole)
    df = spark.range(3000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"), (F.xxhash64("id") % 997).alias("v"))
    wanted = {"low": (F.col("v"), 0.1), "mid": (F.col("v"), 0.5), "other": (F.col("v") * 2, 0.9)}
    sets = [["a", "b"], ["a"], []]
    got = ranks.with_quantiles(df, ["a", "b"], {"n": F.count("v"), "total": F.sum("v")}, wanted, sets)
    assert got.columns == ["a", "b", "n", "total", "low", "mid", "other"]
    want = []
    for own in sets:
        exact = [F.percentile(c.cast("double"), F.lit(p)) for c, p in wanted.values()]
        want += [(r["a"] if "a" in own else None, r["b"] if "b" in own else None, *r[len(own) :]) for r in df.groupBy(*own).agg(F.count("v"), F.sum("v"), *exact).collect()]
    digits = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert digits(got.collect()) == digits(want)
    none = ranks.with_quantiles(df.limit(0), ["a", "b"], {"n": F.count("v")}, wanted, sets).collect()
    assert [tuple(r) for r in none] == [(None, None, 0, None, None, None)]


def test_a_small_table_is_read_once_for_all_sets(spark):
    """One aggregation over all grouping sets and percentiles: one scan and one exchange."""
    df = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_quantity")
    got = ranks.with_quantiles(df, ["l_returnflag", "l_linestatus"], {"n": F.count("*")}, {"m": (F.col("l_quantity"), 0.5), "h": (F.col("l_quantity"), 0.9)}, [["l_returnflag", "l_linestatus"], []])
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and len(re.findall(r"[ +\-:]Exchange", text)) == 1


@pytest.mark.parametrize("name", sorted(UNBOUNDED))
def test_no_percentile_over_a_group_without_a_bound(spark, name, monkeypatch):
    """Of tables beyond WHOLE rows only windows of a file, which have a bound, take the built-in median."""
    monkeypatch.setattr(ranks, "WHOLE", 0)
    text = UNBOUNDED[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    for line in text.splitlines():
        if "Aggregate [" in line and re.search(r"\b(median|percentile)\(", line):
            assert "window_idx" in line or "floor(" in line
