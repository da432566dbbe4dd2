"""Which of alike rows stays, and what is left in the scratch folder."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from tidewake.llm import common, exact_dedup, simhash
from tidewake.llm.common import Scratch, passing, shared_root

ROWS = [(1, "same text here", "fr", 3), (1, "same text here", "de", 9), (1, "same text here", None, 1), (1, "same text here", "de", 2), (2, "another", "en", 0)]


@pytest.mark.parametrize("stage", [exact_dedup.drop_copies, simhash.drop_near_copies])
def test_the_least_of_alike_rows_stays(spark, stage):
    kept = set()
    for order in list(itertools.permutations(ROWS))[::40]:
        docs = spark.createDataFrame(list(order), "doc_id long, text string, lang string, n int").repartition(3)
        kept.add(tuple(sorted(map(tuple, stage(docs).collect()))))
    assert kept == {((1, "same text here", None, 1), (2, "another", "en", 0))}


def test_columns_without_an_order_come_along(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, n int").withColumn("more", F.create_map(F.lit("k"), F.col("n")))
    got = exact_dedup.drop_copies(docs).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n"], r["more"]) for r in got] == [(1, 1, {"k": 1}), (2, 0, {"k": 0})]


def test_scratch_begun_within_is_dropped(spark):
    before = Scratch(spark, "t")
    before.save(spark.range(2).toDF("x"), "a")
    with passing():
        inner = Scratch(spark, "t")
        inner.save(spark.range(2).toDF("x"), "a")
        with passing():
            Scratch(spark, "t").save(spark.range(2).toDF("x"), "a")
    left = os.listdir(f"{shared_root(spark).removeprefix('file://')}/tidewake")
    assert os.path.basename(before.root) in left and os.path.basename(inner.root) not in left and not common._OPEN


def test_one_folder_for_a_session_of_its_own(spark):
    if spark.conf.get("spark.checkpoint.dir", None):
        pytest.skip("the session names a folder")
    assert len({shared_root(spark) for _ in range(3)}) == 1
