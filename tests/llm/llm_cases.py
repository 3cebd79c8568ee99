"""Small tables for the tests of the corpus operators."""

import re

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
])
PAGES = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType())])

SENTENCE = "The quick brown fox jumps over the lazy dog near the old river bank. "
LONG = SENTENCE * 4_000

# Nulls in every column, empty and very long texts, ties and repeated rows.
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 10), (2, "", "en", "a", 0), (3, None, "en", "b", None),
    (4, LONG, "en", "b", len(LONG)), (5, " \t\n ", None, None, 4), (None, "no id at all here, only words", "fr", "a", 5),
    (None, None, None, None, None), (6, "alpha beta gamma delta epsilon zeta", "en", "a", 10),
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 10), (1, "another text for the same id", "en", "a", 10),
    (7, "Ünïcödé ünd Straße — ñandú 漢字\x00 end", "de", "c", 30), (8, "one", "en", "c", 3), (9, "one", "en", "c", 3),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCUMENTS)


def with_clashes(docs, *names):
    """``docs`` with extra columns of the given names."""
    return docs.withColumns({n: F.lit(f"clash of {n}") for n in names})


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
