"""Totals from partial summaries against totals over all windows, for any order of additions."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.test_segments import near
from tidewake.operators import files, partials, ranks, rounding, windows
from tidewake.plans.windows import CFG, _prepared


def rows(df, digits=6):
    short = lambda v: round(v, digits) + 0.0 if isinstance(v, float) else v
    return sorted(([short(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    frames = _prepared(spark, DATA)
    root = F.concat(F.lit("session"), F.regexp_extract("file", r"_time_(\d+)_", 1))
    win = rounding.round_table(windows.window_table(frames, CFG)).withColumn("root", root).cache()
    return win, windows.bending_counts(frames, ["file"]).withColumn("root", root).cache()


def test_any_order_and_adding_again(spark, tables, tmp_path):
    win, counts = tables
    want = {by: files.integrate(win, counts, [["root"]] if by else None) for by in (False, True)}
    for k, lots in enumerate(([0, 1, 2], [2, 0, 2, 1, 0])):
        path = str(tmp_path / str(k))
        assert partials.known(spark, path) is None
        for lot in lots:
            own = F.pmod(F.hash("file"), F.lit(3)) == lot
            partials.add(spark, path, win.where(own), counts.where(own), ["root", "file"])
        for by in (False, True):
            got = partials.totals(spark, path, ["root"] if by else None)
            assert sorted(got.columns) == sorted(want[by].columns)
            assert rows(got) == rows(want[by])


def test_what_a_broken_run_left_does_not_count(spark, tables, tmp_path, monkeypatch):
    win, counts = tables
    path, own = str(tmp_path / "p"), F.pmod(F.hash("file"), F.lit(2))
    partials.add(spark, path, win.where(own == 0), counts.where(own == 0), ["root", "file"])
    before = rows(partials.totals(spark, path))
    partials.summarise(win.where(own == 1), ["root", "file"])["moments"].withColumn("run", F.lit("broken")).write.mode("append").parquet(f"{path}/moments")
    assert rows(partials.totals(spark, path)) == before
    monkeypatch.setattr(ranks, "WHOLE", 0)
    assert near(rows(partials.totals(spark, path))) == near(before)
