"""Connected components of links between files, by alternating stars.

Two steps take turns. In a large star every file links its larger neighbours to the smallest file it
knows, itself included; in a small star its smaller neighbours and itself. Both keep components
together, and after about log(size) turns every component is one star around its smallest file,
which a further turn does not change. No step holds a file's neighbours together: the smallest of
them is an aggregate with partial results, and it is joined back to the links with ``lookup``, which
deals out the links of a hub. So a file linked to all others is as good as any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photarium.operators.lookup import HOT_ROWS, lookup
from photarium.session import drop_path, scratch_path, settle


def _large_star(links: DataFrame, hot_rows: int) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return lookup(both, smallest, "u", hot_rows).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, hot_rows: int) -> DataFrame:
    smallest = links.groupBy("u").agg(F.min("v").alias("m"))
    lower = lookup(links, smallest, "u", hot_rows).filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()


def _written(links: DataFrame, before: str | None) -> tuple[DataFrame, str]:
    """``links`` as a table that takes the place of the one before."""
    path = scratch_path(links.sparkSession, "stars")
    table = settle(links, "stars", path)
    if before:
        drop_path(links.sparkSession, before)
    return table, path


def _signature(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, root): for every id in ``links`` (left_id, right_id) the smallest one it is connected with.

    Links may be repeated, in either direction, and of a file to itself; those with a null are no
    links. ``hot_rows`` is the number of links of one file from which they are dealt out.
    """
    given = settle(
        links.select("left_id", "right_id").filter(F.col("left_id").isNotNull() & F.col("right_id").isNotNull()), "links"
    )
    high, low = F.greatest("left_id", "right_id"), F.least("left_id", "right_id")
    stars, path = _written(given.filter(high > low).select(high.alias("u"), low.alias("v")).distinct(), None)
    before, now = None, _signature(stars)
    while now != before and now[0]:
        large, path = _written(_large_star(stars, hot_rows), path)
        stars, path = _written(_small_star(large, hot_rows), path)
        before, now = now, _signature(stars)
    ids = given.select(F.col("left_id").alias("id")).union(given.select("right_id")).distinct()
    return ids.join(stars.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("root"))
