"""What must hold at any size: no texts in shuffles where digests do, no cross joins, bounded groups."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewake.llm import line_dedup, mixing, registry, simhash
from tidewake.llm.common import Scratch, shared_root


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_cross_join(name, spark):
    text = plan(registry.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_choosing_a_mix_is_a_filter(spark):
    """Texts meet the leaves' cuts in a broadcast join: no exchange carries them."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = plan(mixing.production_mix(docs, max_epochs=1))
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_exact_report_moves_digests_only(spark):
    text = plan(registry.QUERIES["op3_exact_dedup"](spark, DATA))
    assert "text#" not in text  # the text was read to make the digests and is gone


def test_a_large_group_of_near_copies_makes_rows_in_proportion(spark):
    """Distinct fingerprints around one point: pairs would be hundreds of thousands, links stay near the number of rows."""
    bits = lambda c, k: F.expr(f"shiftleft(1L, cast({c} % {k} as int))")
    prints = spark.range(1500).select(bits("id", 40).bitwiseXOR(bits("(id div 40)", 40)).alias("fp")).distinct()
    links = simhash.links(prints, Scratch(spark, "t"), crowd=64)
    assert links.count() < 70 * prints.count()


def side(text, table):
    """The lines of a plan from a scan of one of the runs' tables up to the join or union that takes it."""
    lines = text.splitlines()
    for k, line in enumerate(lines):
        if table in line and "FileScan" in line:
            depth, out = re.search(r"[\w*(]", line).start(), []
            for above in reversed(lines[:k]):
                at = re.search(r"[\w*(]", above).start()
                if at < depth:
                    depth = at
                    out.append(above)
                    if "Join" in above or "Union" in above:
                        break
            yield out


def test_runs_are_merged_as_they_lie(spark):
    """A batch is merged with each run without an exchange or a sort of the run; no table and no setting is left behind."""
    before = spark.conf.get(line_dedup.ORDERED, None)
    runs = line_dedup.LineRuns(Scratch(spark, "t"), min_docs=5, fanout=9)
    for k in range(3):
        runs.add(spark.range(100).select((F.col("id") * 3 + k).alias("hi"), F.col("id").alias("lo"), F.lit(2).cast("long").alias("docs")))
    new = spark.range(50).select("id", F.col("id").alias("lo"), F.lit(1).cast("long").alias("docs")).withColumnRenamed("id", "hi")
    text = plan(runs._merged(new))
    sides = list(side(text, runs.name))
    assert len(sides) == 3 and text.count("SortMergeJoin") == 3
    assert not any("Exchange" in line or "Sort [" in line for own in sides for line in own)
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs.name)]
    assert spark.conf.get(line_dedup.ORDERED, None) == before


def test_runs_of_many_keys_over_levels(spark, fanout=3):
    """Counts of 6,000 keys over nine batches and three levels are those of a plain groupBy."""
    rows = spark.range(60_000).select(F.pmod(F.xxhash64("id"), F.lit(6000)).alias("k"), F.pmod(F.hash("id"), F.lit(9)).alias("batch"))
    counts = rows.groupBy("batch", F.xxhash64("k").alias("hi"), F.col("k").alias("lo")).agg(F.count("*").alias("docs"))
    with line_dedup.LineRuns(Scratch(spark, "t"), min_docs=10, fanout=fanout) as runs:
        for k in range(9):
            new = counts.where(F.col("batch") == k).select("hi", "lo", "docs")
            if k == 8:
                seen = counts.where("batch < 8").select("hi", "lo")
                fresh = new.join(seen, ["hi", "lo"], "left_anti")
                assert sorted(map(tuple, runs.new_lines(new).collect())) == sorted(map(tuple, fresh.select("hi", "lo", "docs").collect()))
            runs.add(new)
        got = sorted(map(tuple, runs.repeated().collect()))
        assert len(runs.levels) >= 3
    want = counts.groupBy("hi", "lo").agg(F.sum("docs").alias("docs")).where("docs >= 10").select("hi", "lo")
    assert 1000 < len(got) < 6000 and got == sorted(map(tuple, want.collect()))


def test_runs_go_where_a_batch_fails(spark):
    before = spark.conf.get(line_dedup.ORDERED, None)
    with pytest.raises(RuntimeError), line_dedup.LineRuns(Scratch(spark, "t"), min_docs=5) as runs:
        runs.add(spark.range(10).select("id", F.col("id").alias("lo"), F.lit(1).cast("long").alias("docs")).withColumnRenamed("id", "hi"))
        raise RuntimeError
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs.name)] and spark.conf.get(line_dedup.ORDERED, None) == before


def test_search_takes_no_queries_to_the_driver(spark):
    import inspect

    from tidewake.llm import topk

    code = inspect.getsource(topk)
    assert "collect(" not in code and "toLocalIterator" not in code and "broadcast(" not in code


def test_scratch_is_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert root is None or shared_root(spark) == root
    own = Scratch(spark, "t")
    saved = own.save(spark.range(3).toDF("x"), "a")
    assert saved.count() == 3 and re.match(rf"{re.escape(shared_root(spark))}/tidewake/t-\w+", own.root)
    own.drop("a")
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(own.path("a")).count()
