"""The cleaning pipeline over ``documents``: each stage reads what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between two stages the rows are written as Parquet and
read again. All stages but the last return the columns of ``docs``; the last adds ``mix_passes``, how often the
mix reads the document, and ``mix_finish``, its place in the queue.

Defined results: a null or empty text has no words, so the base rule of the first stage drops it. Null ids, sources and
languages stay as they are: rows without an id are judged like others, are never the source of a passage, and a null
source is one source of the mix. Of repeated rows one stays. Texts of any length are worked through whole, in slices. An
empty table passes all stages as an empty table. Extra columns stay, whatever their names, but for the two that the mix
adds and replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framebasin.llm import decontam, fertility, mixing, neardup, substring
from framebasin.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the fertility bands of the clean labelled rows (operator 9)."""
    return fertility.keep_good(docs, labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates: five words, 0.8 (operator 5)."""
    return neardup.distinct_documents(docs, neardup.Plan(width=5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the document with the smallest id only (operator 6)."""
    return substring.without_repeats(docs, window=50)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark`` (operator 2)."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix by source weights reads at least once (operator 1)."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
]

#: Tokenisers, sketches and BM25 have no SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
