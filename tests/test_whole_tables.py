"""Queries run over all rows of their tables."""

import pytest

from tests.conftest import DATA
from tidewake.operators import diel as operators
from tidewake.plans import common, diel, misc, windows

WHOLE = {"horizontal_stats": "lineitem", "numeric_coercion": "orders"}


@pytest.mark.parametrize("name, source", WHOLE.items())
def test_every_row_is_there(name, source, spark, duck):
    queries, oracles = windows.QUERIES | misc.QUERIES, windows.ORACLES | misc.ORACLES
    n = spark.read.parquet(f"{DATA}/{source}.parquet").count()
    assert queries[name](spark, DATA).count() == n
    assert duck.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchone()[0] == n


@pytest.mark.parametrize("name", ["bubble_raster", "annotation_means"])
def test_every_observation_is_there(name, spark):
    whole = common.rounded(getattr(operators, name)(common.observations(spark, DATA)))
    assert sorted(map(repr, diel.QUERIES[f"diel_{name}"](spark, DATA).collect())) == sorted(map(repr, whole.collect()))
    assert "150" not in diel.ORACLES[f"diel_{name}"] and "value > 100" not in diel.ORACLES[f"diel_{name}"]
