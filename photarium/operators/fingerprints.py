"""Digests and perceptual fingerprints as column expressions.

A grid is a row-major array of brightness values. Bit i of a fingerprint is the i-th
comparison, lowest bit first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.functions.bits import pack

# Digests that are combined into one of the next level.
FAN = 1_024


def digest(content: Column) -> Column:
    """256-bit digest of bytes, in hex."""
    return F.sha2(content, 256)


def combine_leaves(leaves: DataFrame, key: str, leaf_bytes: int, fan: int = FAN) -> DataFrame:
    """(``key``, digest): the tree digest of each content from those of its leaves (``key``, size_bytes, leaf, digest).

    Up to ``fan`` neighbours become one digest of their digests in order, level by level, until one is
    left, so no group is larger than that however long a content is; a digest without a neighbour goes
    up as it is. The last digest is taken with the sizes, which fix the tree's shape: equal contents
    have equal tree digests, and others differ. A content with a missing digest has none.
    """
    rows = leaves.select(F.col(f"`{key}`").alias("id"), "size_bytes", F.col("leaf").alias("place"), "digest")
    most = rows.agg(F.coalesce(F.max("place"), F.lit(0)) + 1).first()[0]
    while most > 1:
        children = F.sort_array(F.collect_list(F.struct("place", "digest")))
        whole = F.count("digest") == F.count(F.lit(1))
        joined = F.array_join(F.transform(children, lambda c: c["digest"]), "")
        digest_of = F.when(F.size(children) == 1, children[0]["digest"]).otherwise(F.sha2(joined.cast("binary"), 256))
        rows = rows.groupBy("id", "size_bytes", F.floor(F.col("place") / fan).alias("up")).agg(
            F.when(whole, digest_of).alias("digest")
        ).withColumnRenamed("up", "place")
        most = -(-most // fan)
    head = F.concat_ws(":", F.col("size_bytes").cast("string"), F.lit(str(leaf_bytes)), F.lit(str(fan)), "digest")
    return rows.select(F.col("id").alias(key), F.when(F.col("digest").isNotNull(), F.sha2(head.cast("binary"), 256)).alias("digest"))


def tree_digest(contents: DataFrame, key: str, content: str, leaf_bytes: int, fan: int = FAN) -> DataFrame:
    """(``key``, digest): tree digest of each row's bytes; null content has none. Keys are unique."""
    size = F.octet_length(F.col(f"`{content}`")).cast("bigint")
    rows = contents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{content}`").cast("binary").alias("bytes"), size.alias("size_bytes"))
    count = F.greatest(F.ceil(F.col("size_bytes") / leaf_bytes), F.lit(1)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(i.cast("bigint").alias("leaf"), F.sha2(F.substring("bytes", i * leaf_bytes + 1, F.lit(leaf_bytes)), 256).alias("digest")),
    )
    leaves = rows.filter(F.col("bytes").isNotNull()).select("id", "size_bytes", F.inline_outer(cut))
    none = rows.filter(F.col("bytes").isNull()).select(F.col("id").alias(key), F.lit(None).cast("string").alias("digest"))
    return combine_leaves(leaves.withColumnRenamed("id", key), key, leaf_bytes, fan).unionByName(none)


def _whole(grid: Column, width: int, height: int, value: Column) -> Column:
    """NULL unless the grid has every cell, so that a short grid is not read as dark."""
    return F.when(F.size(grid) == width * height, value)


def _darker(grid: Column, cells: list[int], step: int) -> Column:
    """For each cell number: is it darker than the cell ``step`` further on?"""
    return F.transform(
        F.array(*[F.lit(c) for c in cells]), lambda c: F.get(grid, c) < F.get(grid, c + step)
    )


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mean_hash(grid: Column, width: int, height: int) -> Column:
    """One bit per cell: at least as bright as the mean."""
    total = F.aggregate(grid, F.lit(0.0), lambda a, b: a + b)
    bits = _with(total, lambda t: F.transform(grid, lambda cell: cell * (width * height) >= t))
    return _whole(grid, width, height, pack(bits))


def _across(grid: Column, width: int, height: int) -> Column:
    return _darker(grid, [y * width + x for y in range(height) for x in range(width - 1)], 1)


def gradient_hash(grid: Column, width: int, height: int) -> Column:
    """One bit per horizontal neighbour pair: left darker than right."""
    return _whole(grid, width, height, pack(_across(grid, width, height)))


def double_gradient_hash(grid: Column, width: int, height: int) -> Column:
    """Horizontal comparisons row by row, then vertical ones."""
    down = _darker(grid, list(range(width * (height - 1))), width)
    return _whole(grid, width, height, pack(F.concat(_across(grid, width, height), down)))
