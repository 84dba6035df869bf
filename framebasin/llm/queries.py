"""Registered queries of this package over the supplied tables, with SQL counterparts where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    classifier, decontam, fertility, lexical, licenses, manifest, mixing, neardup, sharding, substring, urlgraph, warc, wrappers,
)
from .frames import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_mixing", mixing.SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.shares(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_warc", warc.SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.col("main_text")
    return pages.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.components(docs, neardup.Plan(width=2)).drop("text_hash")


@query("op6_substrings", substring.SQL)
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.summary(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)


@query("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"url_host": "host", "url_path": "path", "url_rule": "rule", "url_verdict": "verdict"}
    pages = urlgraph.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", *[F.col(a).alias(b) for a, b in named.items()])


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = classifier.score(docs, model)
    held = classifier.held_out(F.col("doc_id"), classifier.Settings().folds)
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_tokens chars_per_token byte_share token_entropy"
    judged = fertility.judge(docs, labels=table(spark, sf_dir, "labels").select("doc_id", "quality"), keep_text=False)
    return judged.select("doc_id", *[F.col(f"quality_stats.{c}") for c in names.split()])


@query("op10_licenses", licenses.sql())
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    named = "words:n_words base:n_base first:first_word last:last_word base_labels:base_labels labels:labels score:score"
    pairs = [x.split(":") for x in named.split()]
    return licenses.scan(docs).select("doc_id", *[F.col(f"license_{a}").alias(b) for a, b in pairs])


@query("op11_sharding")
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32("text").alias("text_crc32"))
    return sharding.place(docs, sharding.Plan(shards=16)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op12_manifest", manifest.sql())
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit_lowered(table(spark, sf_dir, "documents")).withColumnRenamed("proof", "proof_sha256")


@query("op13_lexical_search", lexical.SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
