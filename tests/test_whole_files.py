"""Whole files decide how they are read, and whole tables are drawn."""

import sys
import types

import pytest

from tidewake.sources import scans, sinks


@pytest.mark.parametrize("letter, ending, encoding", [("é", "", "cp1252"), ("“", "", "cp1252"), ("é", "", "utf-8"), ("x", "é", "cp1252")])
def test_letters_far_into_a_tracking_file(spark, tmp_path, letter, ending, encoding):
    rows = [f"{k},{'a' * 40}" for k in range(3000)] + [f"3000,{letter}"]
    (tmp_path / "a.csv").write_bytes(("frame,note\n" + "\n".join(rows) + ending).encode(encoding))
    got = scans.tracking(spark, str(tmp_path)).where("frame = '3000'").collect()
    assert [r["note"] for r in got] == [letter + ending]


def test_a_file_that_no_encoding_reads_is_left_out(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"frame,note\n" + b"1,a\n" * 20_000 + b"2,\x81\xff\n")
    (tmp_path / "b.csv").write_bytes(b"frame,note\n3,b\n")
    assert [r["frame"] for r in scans.tracking(spark, str(tmp_path)).collect()] == ["3"]


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    """Columns in another order, more and fewer of them, a mark, quotes, blank first lines, other letters: all by name."""
    (tmp_path / "a.csv").write_bytes(b"file,x,y\nf1,1,2\n")
    (tmp_path / "b.csv").write_bytes(b"file,y,x\nf2,2,1\n")
    (tmp_path / "c.csv").write_bytes(b"\xef\xbb\xbffile,x,y,z\nf3,1,2,3\nf4,1\n")
    (tmp_path / "d.csv").write_bytes('"y","file","größe, mm"\n2,"f,5",7\n'.encode("cp1252"))
    (tmp_path / "e.csv").write_bytes("\n\ny,file,größe\n2,f6,é\n".encode())
    (tmp_path / "f.csv").write_bytes(b"file,x,x,\nf7,1,4,5\n")
    got = scans.tracking(spark, str(tmp_path))
    assert got.columns == ["file", "x", "y", "z", "größe, mm", "größe", "x.1", "Unnamed: 3", "source_path", "root"]
    rows = {r["file"]: [r[c] for c in got.columns[1:8]] for r in got.collect()}
    assert rows == {"f1": ["1", "2"] + [None] * 5, "f2": ["1", "2"] + [None] * 5, "f3": ["1", "2", "3"] + [None] * 4, "f4": ["1"] + [None] * 6,
                    "f,5": [None, "2", None, "7", None, None, None], "f6": [None, "2", None, None, "é", None, None], "f7": ["1", None, None, None, None, "4", "5"]}


def test_headers_of_files_in_many_blocks(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for k in range(4):
            names = ("frame,a,b", "frame,b,a")[k % 2]
            (tmp_path / f"{k}.csv").write_text(names + "\n" + "\n".join(f"{i},{(i, -i)[k % 2]},{(-i, i)[k % 2]}" for i in range(1, 5000)) + "\n")
        got = scans.tracking(spark, str(tmp_path)).selectExpr("sum(a) a", "sum(b) b", "count(*) n").first()
        assert tuple(got) == (4 * 12_497_500, -4 * 12_497_500, 4 * 4999)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_file_with_a_longer_row_is_left_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text("file,x\nf1,1\nf2,1,2\n")
    (tmp_path / "b.csv").write_text('file,x\n"f,3",1\n')
    got = {r["file"].rsplit("/", 1)[1]: (r["ok"], r["error"]) for r in scans.tracking_files(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (False, "a row of 3 fields under a header of 2"), "b.csv": (True, None)}
    assert [r["file"] for r in scans.tracking(spark, str(tmp_path)).collect()] == ["f,3"]


def test_summaries_meet_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('file,n,m\ns1,"1,200",3\n')
    (tmp_path / "b.csv").write_text("m,file\n4,s2\n")
    got = {r["file"]: (r["n"], r["m"]) for r in scans.summary(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"]).collect()}
    assert got == {"s1": (1200.0, 3.0), "s2": (None, 4.0)}


def test_a_figure_draws_all_rows_or_none(spark, tmp_path, monkeypatch):
    drawn, axes = [], types.SimpleNamespace(figure=types.SimpleNamespace(savefig=lambda path: None))
    pyplot = types.SimpleNamespace(close=lambda figure: None)
    monkeypatch.setitem(sys.modules, "matplotlib", types.SimpleNamespace(use=lambda backend: None, pyplot=pyplot))
    monkeypatch.setattr("pandas.DataFrame.plot", lambda pdf, x, y: drawn.append(len(pdf)) or axes)
    df = spark.range(20).selectExpr("id as x", "id as y")
    assert sinks.figure(df, str(tmp_path / "f.png"), "x", ["y"], most=20) and drawn == [20]
    with pytest.raises(ValueError, match="19 points"):
        sinks.figure(df, str(tmp_path / "f.png"), "x", ["y"], most=19)
    assert drawn == [20]


def test_figures_shade_nights_and_draw_bands(spark, tmp_path, monkeypatch):
    calls, axes = [], types.SimpleNamespace(figure=types.SimpleNamespace(savefig=lambda path: calls.append("saved")))
    axes.axvspan = lambda lo, hi, **_: calls.append((lo, hi))
    axes.fill_between = lambda x, lo, hi, **_: calls.append((list(lo), list(hi)))
    axes.imshow = lambda cells, **_: calls.append(cells.shape)
    axes.set_xticks = axes.set_yticks = lambda at, names: calls.append(list(names))
    fig = types.SimpleNamespace(colorbar=lambda image: None, savefig=lambda path: calls.append("saved"))
    pyplot = types.SimpleNamespace(close=lambda figure: None, subplots=lambda: (fig, axes))
    monkeypatch.setitem(sys.modules, "matplotlib", types.SimpleNamespace(use=lambda backend: None, pyplot=pyplot))
    monkeypatch.setattr("pandas.DataFrame.plot", lambda pdf, x, y, kind="line": calls.append(kind) or axes)
    df = spark.range(2).selectExpr("id as hour_bin", "cast(id as double) as mean", "0.5D as std")
    assert sinks.figure(df, str(tmp_path / "f.png"), "hour_bin", ["mean"], kind="bar", day=(6, 20), band="std")
    assert calls == ["bar", (0, 6), (20, 24), ([-0.5, 0.5], [0.5, 1.5]), "saved"]
    calls.clear()
    assert sinks.heatmap(df, str(tmp_path / "h.png"), "hour_bin", ["mean", "std"]) and calls == [(2, 2), ["mean", "std"], ["0", "1"], "saved"]
    with pytest.raises(ValueError, match="1 points"):
        sinks.heatmap(df, str(tmp_path / "h.png"), "hour_bin", ["mean"], most=1)
    monkeypatch.setitem(sys.modules, "matplotlib", None)
    assert not sinks.figure(df, "x", "hour_bin", ["mean"]) and not sinks.heatmap(df, "x", "hour_bin", ["mean"])
