"""Rows that do not fit are reported or left out, whatever the path."""

import pytest
from framebasin.operators import labels, metrics, running, sampling
from framebasin.sources import frames, lines, trajectory
from pyspark.sql import functions as F


def test_top_n_skips_missing_values(spark):
    rows = [(0, "a", 0.9), (1, "a", None), (2, "a", 0.5), (3, "b", 0.7), (4, "b", float("nan"))]
    df = spark.createDataFrame(rows, "frame_idx long, source string, u double")
    assert [r.frame_idx for r in sampling.top_n(df, "u", 2).collect()] == [0, 3]
    assert {r.frame_idx for r in sampling.top_n(df, "u", 2, per=["source"]).collect()} == {0, 2, 3}
    assert {r.frame_idx for r in sampling.top_n(df, "u", 2000, per=["source"]).collect()} == {0, 2, 3}


@pytest.mark.parametrize("hot", [5, 100, 1_000_000])
def test_null_groups_survive_a_split(spark, hot):
    rows = [(None if k % 3 == 0 else k % 2, k) for k in range(300)]
    df = spark.createDataFrame(rows, "g long, k long")
    o = running.Ordered(df, ["g"], ["k"], hot_rows=hot).rank("r").group_size("n").running_sum({"s": F.col("k")}).lag({"p": F.col("k")})
    got = {r.k: (r.r, r.n, r.s, r.p) for r in o.result().collect()}
    for g in (None, 0, 1):
        mine = [k for h, k in rows if h == g]
        for i, k in enumerate(mine):
            assert got[k] == (i, len(mine), sum(mine[: i + 1]), mine[i - 1] if i else None)


def test_histogram_leaves_nan_out(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,), (2.0,)], "v double")
    got = [(r.bin, r.left, r.n) for r in metrics.histogram(df, "v", 2).orderBy("bin").collect()]
    assert got == [(0, 0.0, 1), (1, 1.0, 2)]


def test_positional_joins_report_a_missing_row(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "row_no long, a string")
    b = spark.createDataFrame([(0, 1.0), (2, 3.0)], "row_no long, b double")
    assert labels.join_by_row(a, b, whole=False).count() == 2
    with pytest.raises(Exception, match="row counts differ: 1 is missing"):
        labels.join_by_row(a, b).collect()


def test_numbers_hold_when_splits_move(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {k}\n" for k in range(20_000)))
    (tmp_path / "f.xyz").write_text("".join(f"2\ntag={k}\nMo 0 0 {k}\nTe 1 1 {k}\n" for k in range(3000)))
    old = spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "4")
        numbered = lines.read_lines(spark, str(tmp_path / "a.txt"))
        read = frames.read_frames(spark, str(tmp_path / "f.xyz"))
        spark.conf.set("spark.sql.files.minPartitionNum", "7")
        assert numbered.where("line = concat('line ', line_no)").count() == 20_000
        assert read.select("frame_idx").distinct().count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if old is None else spark.conf.set("spark.sql.files.minPartitionNum", old)


@pytest.mark.parametrize(("rows", "good"), [(2, True), (1, False), (3, False)])
def test_direct_blocks_have_the_rows_of_the_header(spark, tmp_path, rows, good):
    body = "".join(f"0.{k} 0.1 0.2\n" for k in range(rows))
    text = "t\n1.0\n10 0 0\n0 10 0\n0 0 10\nMo Te\n1 1\n" + "".join(f"Direct configuration= {k}\n{body}" for k in (1, 2))
    (tmp_path / "XDATCAR").write_text(text)
    df = trajectory.read_xdatcar(spark, str(tmp_path / "XDATCAR"))
    if good:
        assert df.count() == 4
    else:
        with pytest.raises(Exception, match=f"has {rows} rows, not 2"):
            df.collect()


def test_a_stream_refuses_a_short_frame(spark, tmp_path):
    from framebasin.streaming.ingest import ingest_stream

    whole = "2\ntag=1\nMo 0 0 0\nTe 1 1 1\n"
    for name, text in (("good", whole + whole.replace("1 1 1", "0.5 1 1") + whole), ("bad", whole + "3\ntag=2\nMo 0 0 0\nTe 1 1 1\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.xyz").write_text(text)
    out = str(tmp_path / "table")
    ingest_stream(spark, str(tmp_path / "good"), out, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    with pytest.raises(Exception, match="frame 1 is cut short"):
        ingest_stream(spark, str(tmp_path / "bad"), str(tmp_path / "t2"), str(tmp_path / "c2")).awaitTermination()
