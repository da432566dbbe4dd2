import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).parent.parent), os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    """A value that compares equal on both sides."""
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    return v.isoformat()[:10] if hasattr(v, "isoformat") else v


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


@pytest.fixture
def same(spark, duck):
    """Asserts that a query and its SQL give the same columns and rows."""

    def check(query, sql):
        got, want = query(spark, DATA).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return check
