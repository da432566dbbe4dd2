"""Places and neighbours by ranges against windows over whole groups."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tests.test_plans import plan
from tidewake.operators import numbering


def table(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", None, "a", "b"]), k, rng.choice([None, 1, 2, 3]), f"v{k}" if k % 7 else None) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame([*rows, ("alone", 0, None, None)], "g string, k int, tie int, v string").repartition(5)


@pytest.fixture(autouse=True)
def without_coalescing(spark):
    """Small parts stay parts, so that rows meet over their edges."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_places(spark, by):
    df = table(spark)
    order = ["k", "g"]
    got = numbering.numbered(df, [F.col(o) for o in order], by)
    assert got.columns == [*df.columns, "place"]
    want = df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_neighbours(spark, by):
    df = table(spark)
    got = numbering.with_next(df, "v", [F.col("k"), F.col("g")], "after", by)
    want = df.withColumn("after", F.lead("v").over(W.partitionBy(*by).orderBy("k", "g")))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_ties_have_places_of_their_own_and_neighbours_agree_with_them(spark):
    laid = numbering.laid_out(table(spark), [F.col("tie")], ["g"])
    rows = [tuple(r) for r in laid.places().select("g", "tie", "place", "k").collect()]
    groups = {}
    for g, tie, place, k in rows:
        groups.setdefault(g, []).append((place, tie or 0, k))
    for own in groups.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and [t for _, t, _ in own] == sorted(t for _, t, _ in own)
    after = {r["k"]: r["n"] for r in laid.lead("k", "n").where("g = 'hot'").collect()}
    ks = [k for _, _, k in groups["hot"]]
    assert after == dict(zip(ks, [*ks[1:], None], strict=True))


def test_names_that_clash_and_no_rows(spark):
    df = spark.range(10).select("id", *[F.lit(c).alias(c) for c in ("_part", "_row", "_n", "_start", "_first", "_every", "part", "head")])
    got = numbering.numbered(df, [F.col("id").desc()])
    assert {r["id"]: r["place"] for r in got.collect()} == {k: 9 - k for k in range(10)} and got.columns == [*df.columns, "place"]
    assert {r["id"]: r["n"] for r in numbering.with_next(df, "id", [F.col("id")], "n").collect()} == {k: k + 1 if k < 9 else None for k in range(10)}
    assert numbering.numbered(df.limit(0), [F.col("id")]).collect() == [] == numbering.with_next(df.limit(0), "id", [F.col("id")], "n").collect()


def test_a_large_group_is_in_many_parts(spark):
    laid = numbering.laid_out(spark.range(4000).withColumn("g", F.lit(1)), [F.col("id")], ["g"])
    parts = [r["c"] for r in laid.rows.groupBy("_part").agg(F.count("*").alias("c")).collect()]
    assert len(parts) >= 3 and max(parts) < 2500
    windows = [line for line in plan(laid.places()).splitlines() if "Window [" in line]
    assert not windows  # sums over edges are written by then
