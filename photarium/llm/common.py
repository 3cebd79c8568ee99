"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.session import settle

# A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Characters of text a Python function takes apart at a time; longer texts go alone.
BLOCK_CHARS = 2_000_000

__all__ = ["BLOCK_CHARS", "WORD", "bucket_of", "read", "scores_of", "settle", "slices", "table_or_empty", "unit"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def unit(*parts: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the values of ``parts`` and the seed only.

    52 bits of an MD5 digest, so any engine with MD5 computes the same.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def table_or_empty(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns of ``df`` cast to the given types; columns it lacks are null."""
    return df.select(*(
        (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in columns.items()
    ))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that no slice has more than ``chars`` bytes of text, but for single long rows."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + chars, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def scores_of(values: np.ndarray) -> np.ndarray:
    """The logistic function, without overflow."""
    return 1.0 / (1.0 + np.exp(-np.clip(values, -60.0, 60.0)))
