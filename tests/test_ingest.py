import os

import pytest
from framebasin.streaming.ingest import ingest_stream
from pyspark.sql import functions as F


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def put(folder, name, tags):
    text = "".join(f"2\nLattice=\"900 0 0 0 900 0 0 0 900\" name=n{t}\nMo 0 0 {t}.5\nTe 1 {t} 1\n" for t in tags)
    (folder / name).write_text(text)


def names(spark, table):
    return sorted(r[0] for r in spark.read.parquet(table).select(F.col("info")["name"]).collect())


def test_contents_pass_once_over_runs_and_repeated_batches(spark, tmp_path, small_splits):
    source, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    source.mkdir()

    def run():
        ingest_stream(spark, str(source), table, state, maxFilesPerTrigger=1).awaitTermination()
        return names(spark, table)

    put(source, "a.xyz", [*range(200), 3, 4])  # several splits, contents that repeat
    put(source, "b.xyz", [5, 300])
    want = sorted(f"n{t}" for t in [*range(200), 300])
    assert run() == want
    assert run() == want
    put(source, "c.xyz", [300, 301, 7])
    want = sorted([*want, "n301"])
    assert run() == want
    # a failure after the frames were staged and before the batch was noted: it runs again
    commits = os.path.join(state, "cut", "commits")
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(os.path.join(commits, f)):
            os.remove(os.path.join(commits, f))
    assert run() == want


def test_an_empty_folder_gives_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination()
    assert names(spark, str(tmp_path / "t")) == []


def test_the_number_of_derived_files_is_bounded(spark):
    from framebasin.plans.standins import frames_per_file

    def ids(n, step=1):
        return spark.range(0, n * step, step).withColumnRenamed("id", "frame_idx")

    assert frames_per_file(ids(0)) == frames_per_file(ids(2000)) == 512
    assert 600_000 / frames_per_file(ids(600_000)) <= 16
    assert 600_000 * 7 / frames_per_file(ids(600_000, 7)) <= 16  # gaps between the ids
    assert frames_per_file(ids(3_000_000)) <= 65_536 * 1.1  # files stay bounded too
