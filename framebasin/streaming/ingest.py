"""K1: incremental ingest of frame files into a table of unique frames.

Three queries follow one another. The first reads new files as lines in splits, cuts frames out of them (a file may be
larger than a split or a row) and stages the lines of the frames of each batch in a folder of its own, so a batch that
is repeated after a failure replaces itself; a batch of few files does no more than that. The second reads all frames
that were staged since it last ran, parses them in one pass and stages the first of each content, again in a folder of
its own. The third streams these through a state store keyed by fingerprint, which lets each content pass once; a batch
reads its own rows and the state of its keys, never the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import fingerprints
from ..sources.blocks import blocks_of
from ..sources.frames import assemble

_BLOCKS = "file string, frame_idx long, line_no long, ls array<string>"


def _marked(blocks: DataFrame) -> DataFrame:
    """Frames with the fingerprint that ties species to positions (``tied``)."""
    return fingerprints(assemble(blocks)).drop("loose", "exact", "crowded", "frac")


def _cut(batch: DataFrame, batch_id: int, folder: str) -> None:
    """The frames of one batch of files as arrays of lines."""
    blocks_of(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def _stage(batch: DataFrame, batch_id: int, folder: str) -> None:
    """The frames of one batch, the first of each content in order of file and frame."""
    marked = _marked(batch)
    first = F.min_by(F.struct(*marked.columns), F.struct("file", "frame_idx")).alias("row")
    once = marked.groupBy("tied").agg(first).select("row.*")
    once.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def _passed(rows: DataFrame, write, folder: str, checkpoint: str) -> None:
    """``write`` has worked through all batches of ``rows`` when this returns."""
    query = (
        rows.writeStream.foreachBatch(lambda df, i: write(df, i, folder))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest_stream(spark: SparkSession, path: str, table: str, checkpoint: str, **options) -> StreamingQuery:
    """K1: new files below ``path`` are added to ``table``, each content once; returns the last query.

    The checkpoint remembers which files were read and which contents passed. A frame that is cut short is an error.
    """
    lines_of, staged = f"{checkpoint}/blocks", f"{checkpoint}/frames"
    none = spark.createDataFrame([], _BLOCKS)
    empty = _marked(none)
    for df, folder in ((none, lines_of), (empty, staged)):  # the schemas, before any file has come
        df.coalesce(1).write.mode("ignore").parquet(f"{folder}/batch=-1")
    rows = spark.readStream.format("text").options(**options).load(path)
    lines = rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"), F.rtrim("value").alias("line")
    )
    _passed(lines, _cut, lines_of, f"{checkpoint}/cut")
    blocks = spark.readStream.schema(none.schema).parquet(lines_of).select(*none.columns)
    _passed(blocks, _stage, staged, f"{checkpoint}/parsed")
    frames = spark.readStream.schema(empty.schema).parquet(staged)
    return (
        frames.dropDuplicates(["tied"])
        .writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", f"{checkpoint}/unique")
        .trigger(availableNow=True)
        .start()
    )
