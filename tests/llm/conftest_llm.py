import random
import re

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside or return
        *[T.StructField(c, T.StringType()) for c in ("_id", "_th", "_source", "size", "label", "kept", "_own", "host", "finish", "text_hash")],
    ]
)
EXTRA = [f"x{k}" for k in range(10)]


def doc_row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice('abcdeé')}" for _ in range(n))


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows, copies and near copies."""
    base = prose(1, 300)
    rows = [
        doc_row(1, base), doc_row(2, base), doc_row(2, base), doc_row(3, edited(base, 3, 0.02)),
        doc_row(4, None, None, None), doc_row(5, ""), doc_row(6, " \t\n"), doc_row(7, "one"), doc_row(8, "One"),
        doc_row(9, "two words", "fr", None), doc_row(None, prose(2, 60), None, "b"), doc_row(None, None, None, None),
        doc_row(10, prose(5, 40_000, 3000), "de", "b"), doc_row(11, prose(6, 80) + " " + base[:500], "xx", "c"),
        doc_row(11, prose(7, 90), "es", "c"), doc_row(12, "x y z \x1cq", "en", "ü"), doc_row(13, "a " * 200, "en", "d"),
    ]
    rows += [doc_row(100 + k, edited(base, 100 + k, 0.04), source="d") for k in range(12)]
    rows += [doc_row(200 + k, prose(200 + k, 30 + k), source="e") for k in range(25)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
