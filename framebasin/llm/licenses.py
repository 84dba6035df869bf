"""License scans by diagonal voting, with DataFrame functions only.

All word k-grams of every text (two words, and three for long templates) are joined to the positions of the same
words in a small table of templates. A hit votes for the diagonal ``text position - template position``. Votes of a
diagonal are combined, diagonals that differ by at most ``slack`` words are merged, and a span counts if its hits
cover enough of the template's words. The join compares the words themselves behind their hash, so every covered
word is verified. Phrases of the base rule are templates that must lie on one diagonal, whole.

The template table is broadcast: its size is that of the parameter, some hundred rows, and never that of the data.

Defined results: null and empty texts have no words, no labels and score 0. Texts shorter than a k-gram match
nothing. Repeated rows get equal results, one each. An empty table gives an empty result. Extra columns stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import carry, lower_ascii, restore

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False  # a phrase that must match whole

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())

    @property
    def whole(self) -> bool:
        """Short templates differ from each other in a word or two, so all their words must be there."""
        return self.base or len(self.words) <= 8

    @property
    def k(self) -> int:
        return 2 if self.base or len(self.words) < 6 else 3


TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("mit", "released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Template("gpl-3.0", "GNU General Public License, version 3"),
    Template("gpl-2.0", "GNU General Public License, version 2"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("agpl", "GNU Affero General Public License"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-nc", "CC BY-NC 4.0"),
    Template("cc-by-sa", "CC BY-SA 4.0"),
    Template("cc-by-nd", "CC BY-ND 4.0"),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def _grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(t).alias("t"),
            F.lit(j).alias("j"),
            F.lit(w[j]).alias("w1"),
            F.lit(w[j + 1]).alias("w2"),
            F.lit(w[j + 2] if x.k == 3 else None).cast("string").alias("w3"),
        )
        for t, x in enumerate(templates)
        for w in [x.words]
        for j in range(len(w) - x.k + 1)
    ]
    grams = spark.range(1).select(F.inline(F.array(*rows)))
    return grams.withColumn("h", F.xxhash64("w1", "w2"))


def _of(templates: tuple[Template, ...], value, t: str = "t") -> Column:
    """A property of the template with the number in column ``t``."""
    return F.element_at(F.array(*[F.lit(value(x)) for x in templates]), F.col(t) + 1)


def scan(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    coverage: float = 0.8,
    slack: int = 2,
    text: str = "text",
) -> DataFrame:
    """``docs`` without its text, with license_words, license_base, license_first, license_last,
    license_base_labels, license_labels and license_score (the best coverage; 1 where a base phrase stands)."""
    spark, whole_rows, needed = docs.sparkSession, docs, ("doc_id", text)
    docs = carry(docs, needed)
    body = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    key = [F.xxhash64(F.lit(n), F.to_json(F.struct("doc_id")), F.col(text)) for n in (1, 2)]
    w = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    rows = docs.select(key[0].alias("a"), key[1].alias("b"), w.alias("w"))
    after = lambda n: F.slice(F.col("w"), n + 1, F.greatest(F.size("w"), F.lit(1)))
    placed = rows.select(
        "a", "b", F.posexplode(F.arrays_zip(F.col("w").alias("x"), after(1).alias("y"), after(2).alias("z")))
    ).select("a", "b", F.col("pos").alias("i"), F.col("col.x").alias("x"), F.col("col.y").alias("y"), F.col("col.z").alias("z"))
    g = F.broadcast(_grams(spark, templates))
    same = (
        (F.xxhash64("x", "y") == g.h) & (F.col("x") == g.w1) & (F.col("y") == g.w2) & (g.w3.isNull() | (F.col("z") == g.w3))
    )
    votes = (
        placed.join(g, same)
        .groupBy("a", "b", "t", (F.col("i") - F.col("j")).alias("d"))
        .agg(F.collect_set("j").alias("js"))
    )
    base, whole, length, k = (
        _of(templates, f) for f in (lambda x: x.base, lambda x: x.whole, lambda x: len(x.words), lambda x: x.k)
    )
    order = Window.partitionBy("a", "b", "t").orderBy("d")
    apart = F.when(F.col("d") - F.lag("d").over(order) <= F.when(base, 0).otherwise(slack), 0).otherwise(1)
    merged = (
        votes.withColumn("new", apart)
        .withColumn("span", F.sum("new").over(order))
        .groupBy("a", "b", "t", "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"), F.min("d").alias("d"))
    )
    words_hit = F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + k - 1)))))
    spans = merged.withColumn("share", words_hit / length)
    found = F.col("share") >= F.when(whole, 1.0).otherwise(coverage)
    is_base = base & (F.col("share") >= 1.0)
    label = _of(templates, lambda x: x.label)
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, label))), ",")
    seen = spans.groupBy("a", "b").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("d"))).alias("first"),
        F.max(F.when(is_base, F.col("d"))).alias("last"),
        joined(is_base).alias("base_labels"),
        joined(found).alias("labels"),
        F.max("share").alias("score"),
    )
    n = F.regexp_count(body, F.lit(WORD))
    every = docs.withColumns({"_a": key[0], "_b": key[1], "license_words": n.cast("long")}).drop(text)
    met = every.join(seen.withColumnsRenamed({c: f"_{c}" for c in seen.columns if c not in "ab"}).withColumnsRenamed({"a": "_ra", "b": "_rb"}), (F.col("_a") == F.col("_ra")) & (F.col("_b") == F.col("_rb")), "left")
    out = met.withColumns(
        {
            "license_base": F.coalesce("_n_base", F.lit(0)).cast("long"),
            "license_first": F.col("_first").cast("long"),
            "license_last": F.col("_last").cast("long"),
            "license_base_labels": F.coalesce("_base_labels", F.lit("")),
            "license_labels": F.coalesce("_labels", F.lit("")),
            "license_score": F.coalesce("_score", F.lit(0.0)),
        }
    )
    new = tuple(f"license_{c}" for c in "words base first last base_labels labels score".split())
    return restore(out, whole_rows, needed, new, drop=(text,))


def sql(templates: tuple[Template, ...] = TEMPLATES, coverage: float = 0.8, slack: int = 2) -> str:
    rows = ", ".join(
        f"({n}, '{x.label}', {x.base}, {x.whole}, {x.k}, {x.words!r})" for n, x in enumerate(templates)
    )
    return rf"""
WITH tpl(t, label, base, whole, k, tw) AS (VALUES {rows}),
tg AS (SELECT t, k, base, j, tw[j + 1] AS w1, tw[j + 2] AS w2, CASE WHEN k = 3 THEN tw[j + 3] END AS w3
       FROM (SELECT *, unnest(range(len(tw) - k + 1)) AS j FROM tpl)),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT r, i, w[i + 1] AS x, w[i + 2] AS y, w[i + 3] AS z FROM (SELECT *, unnest(range(len(w))) AS i FROM d)),
v AS (SELECT DISTINCT r, t, base, k, i - j AS diag, j FROM g JOIN tg ON x = w1 AND y = w2 AND (w3 IS NULL OR z = w3)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY r, t ORDER BY diag) AS span
      FROM (SELECT r, t, diag, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, t ORDER BY diag)
                                         <= CASE WHEN base THEN 0 ELSE {slack} END THEN 0 ELSE 1 END AS fresh
            FROM (SELECT DISTINCT r, t, base, diag FROM v))),
m AS (SELECT r, t, span, min(diag) AS diag, count(DISTINCT place) AS hit
      FROM (SELECT v.r, v.t, span, v.diag, unnest(range(j, j + k)) AS place
            FROM v JOIN s ON v.r = s.r AND v.t = s.t AND v.diag = s.diag)
      GROUP BY r, t, span),
f AS (SELECT r, label, base, whole, diag, hit::DOUBLE / len(tw)::DOUBLE AS share FROM m JOIN tpl USING (t)),
a AS (SELECT r, count(*) FILTER (base AND share >= 1) AS n_base, min(diag) FILTER (base AND share >= 1) AS first_word,
             max(diag) FILTER (base AND share >= 1) AS last_word,
             array_to_string(list_sort(list(DISTINCT label) FILTER (base AND share >= 1)), ',') AS base_labels,
             array_to_string(list_sort(list(DISTINCT label) FILTER (share >= CASE WHEN whole THEN 1 ELSE {coverage} END)), ',') AS labels,
             max(share) AS score
      FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)
"""
