"""Library statistics and duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.functions import units
from photarium.functions.errors import UnknownAlgorithm
from photarium.operators.algorithms import algorithm
from photarium.operators.latest import active, latest_hashes, latest_stats
from photarium.operators.lookup import HOT_ROWS, lookup

TOP_GROUPS = 50


def library_stats(files: DataFrame) -> DataFrame:
    """One row over the present files: counts by type and total size. One pass."""
    kind = F.col("file_type")
    totals = active(files).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"),
        F.count_if(kind == "image").alias("image_count"),
        F.count_if(kind == "video").alias("video_count"),
    )
    return totals.select(
        "total_files", "total_size_bytes", units.gib(F.col("total_size_bytes")).alias("total_size_gib"),
        "image_count", "video_count",
        (F.col("total_files") - F.col("image_count") - F.col("video_count")).alias("other_count"),
    )


def scan_stats(described: DataFrame) -> DataFrame:
    """One row over a listing: count and size in total and by type.

    A file below two roots is counted for each of them.
    """
    kind, size = F.col("file_type"), F.col("size_bytes")

    def bytes_of(condition: Column | None = None) -> Column:
        return F.coalesce(F.sum(size if condition is None else F.when(condition, size)), F.lit(0))

    columns = [F.count(F.lit(1)).alias("total_files"), bytes_of().alias("total_size_bytes")]
    for name in ("image", "video", "other"):
        columns += [
            F.count_if(kind == name).alias(f"{name}_count"),
            bytes_of(kind == name).alias(f"{name}_size_bytes"),
        ]
    return described.agg(*columns)


def duplicate_groups(hashes: DataFrame, stats: DataFrame, hash_name: str) -> DataFrame:
    """Digests shared by several present files, with file count and total size.

    Only the exact digests group files. Both logs are cut to their newest row per file and
    end up partitioned by file, so they join in place; the grouping adds up inside each
    task before the one shuffle by digest, whatever the size of a group.
    """
    if not algorithm(hash_name).lists_duplicates:
        raise UnknownAlgorithm(hash_name)
    newest = (
        latest_hashes(hashes.select("file_id", "stat_id", "hash_name", "hash_value", "computed_at"), hash_name)
        .filter(F.col("hash_value").isNotNull())
        .select("file_id", "hash_value")
    )
    present = active(
        latest_stats(stats.select("file_id", "stat_id", "size_bytes", "is_missing", "observed_at"))
    ).select("file_id", "size_bytes")
    return (
        newest.join(present, "file_id")
        .groupBy("hash_value")
        .agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_size"))
        .filter(F.col("file_count") > 1)
    )


def duplicates_report(hashes: DataFrame, stats: DataFrame, hash_name: str, limit: int = TOP_GROUPS) -> DataFrame:
    """The groups that take the most space, largest first; equal sizes by digest."""
    wasted = units.wasted_bytes(F.col("total_size"), F.col("file_count"))
    return (
        duplicate_groups(hashes, stats, hash_name)
        .orderBy(F.col("total_size").desc(), F.col("hash_value"))
        .limit(limit)
        .select(
            "hash_value", units.digest_prefix(F.col("hash_value")).alias("digest_prefix"),
            "file_count", "total_size", units.mib(wasted).alias("wasted_mib"),
        )
    )


def duplicate_members(hashes: DataFrame, files: DataFrame, hash_name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every file of the duplicate groups: ``hash_value``, ``file_count``, ``file_id``, ``path``, ``size_bytes``, ``is_keeper``.

    ``files`` is the view of files with their latest state. The keeper of a group is its oldest file
    by mtime; of equally old ones the one with the first path, then the smallest id. It is the
    smallest struct of these, so a group is reduced in every task before the shuffle by digest, and
    the digests of large groups are dealt out when keepers are joined back.
    """
    if not algorithm(hash_name).lists_duplicates:
        raise UnknownAlgorithm(hash_name)
    newest = latest_hashes(hashes.select("file_id", "stat_id", "hash_name", "hash_value", "computed_at"), hash_name)
    digests = newest.filter(F.col("hash_value").isNotNull()).select("file_id", "hash_value")
    present = active(files).select(F.col("id").alias("file_id"), "path", "size_bytes", "mtime_secs", "mtime_nanos")
    members = digests.join(present, "file_id")
    oldest = F.min(F.struct("mtime_secs", "mtime_nanos", "path", "file_id"))
    groups = (
        members.groupBy("hash_value").agg(F.count(F.lit(1)).alias("file_count"), oldest["file_id"].alias("_keeper"))
        .filter(F.col("file_count") > 1)
    )
    return lookup(members, groups, "hash_value", hot_rows).select(
        "hash_value", "file_count", "file_id", "path", "size_bytes", (F.col("file_id") == F.col("_keeper")).alias("is_keeper")
    )
