"""From a listing of files to new identities and new observation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.functions import paths
from photarium.operators.latest import latest_stats
from photarium.operators.numbering import largest, number_rows
from photarium.settings import ScanSettings

CARRIED = ["root_dir", "filename", "extension", "size_bytes", "mtime_secs", "mtime_nanos", "file_type"]
STAT_COLUMNS = ["stat_id", "file_id", *CARRIED, "is_missing", "observed_at"]


def describe(listing: DataFrame, settings: ScanSettings = ScanSettings()) -> DataFrame:
    """Add file name, extension and file type to a listing."""
    return (
        listing.withColumn("filename", paths.filename(F.col("path")))
        .withColumn("extension", paths.extension(F.col("path")))
        .withColumn("file_type", paths.file_type(F.coalesce("extension", F.lit("")), settings))
    )


def new_files(found: DataFrame, master: DataFrame) -> DataFrame:
    """(id, path) for paths that have no identity yet, numbered on from the largest id."""
    unseen = found.select("path").distinct().join(master.select("path"), "path", "left_anti")
    return number_rows(unseen, ["path"], largest(master, "id"), "id").select("id", "path")


def missing_paths(known: DataFrame, seen: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Known present files of the scanned roots that the scan did not see.

    ``known`` has root_dir, path and any columns to keep, ``seen`` is the listing, ``roots``
    are the roots that were reachable, in scan order: files of a root that was skipped are
    never missing. A path that an earlier root saw has changed owner and is not missing;
    one that only a later root sees gets a missing row first. Adds ``root_order``.
    """
    ordered = F.array(*[F.lit(r) for r in roots]).cast("array<string>")
    position = F.array_position(ordered, F.col("root_dir"))
    due = known.withColumn("root_order", (position - 1).cast("int")).filter(F.col("root_order") >= 0)
    first_seen = seen.groupBy(F.col("path").alias("seen_path")).agg(F.min("root_order").alias("seen_order"))
    already_seen = (F.col("path") == F.col("seen_path")) & (F.col("seen_order") <= F.col("root_order"))
    return due.join(first_seen, already_seen, "left_anti")


def carry_forward(stats: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Latest values of the given files, flagged missing. Files never observed give no row.

    ``file_ids`` has one row per file (file_id and any columns to keep).
    """
    return (
        latest_stats(stats).select("file_id", *CARRIED)
        .join(file_ids, "file_id")
        .withColumn("is_missing", F.lit(True))
    )


def mark_missing(
    gone: DataFrame, master: DataFrame, stats: DataFrame, observed_at: Column
) -> DataFrame:
    """Observation rows that flag the given paths as missing; unknown paths are ignored."""
    ids = gone.select("path").distinct().join(master, "path").select(F.col("id").alias("file_id"), "path")
    rows = carry_forward(stats, ids)
    return (
        number_rows(rows, ["path"], largest(stats, "stat_id"), "stat_id")
        .withColumn("observed_at", observed_at)
        .select(*STAT_COLUMNS)
    )


def observations(
    described: DataFrame, master: DataFrame, stats: DataFrame, observed_at: Column
) -> DataFrame:
    """One observation row per listed file, whether or not anything changed.

    ``master`` must already hold every listed path.
    """
    rows = (
        described.join(master, "path")
        .select(F.col("id").alias("file_id"), "path", "root_order", *CARRIED)
        .withColumn("is_missing", F.lit(False))
    )
    return (
        number_rows(rows, ["root_order", "path"], largest(stats, "stat_id"), "stat_id")
        .withColumn("observed_at", observed_at)
        .select(*STAT_COLUMNS)
    )


def changes(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Compare a listing with the latest state, path by path.

    ``state`` is new, modified (size or mtime differs), unchanged, reappeared, missing, or
    still_missing for a file that was missing before and is still not there. A path listed
    by several roots counts once, as its last root saw it.
    """
    scan = listing.groupBy("path").agg(
        F.max(F.struct("root_order", "size_bytes", "mtime_secs", "mtime_nanos")).alias("now")
    )
    before = files.select(
        F.col("path").alias("known_path"), "is_missing",
        F.struct("size_bytes", "mtime_secs", "mtime_nanos").alias("was"),
    )
    listed, known = F.col("now").isNotNull(), F.col("was").isNotNull()
    same = (
        (F.col("now.size_bytes") == F.col("was.size_bytes"))
        & (F.col("now.mtime_secs") == F.col("was.mtime_secs"))
        & (F.col("now.mtime_nanos") == F.col("was.mtime_nanos"))
    )
    state = (
        F.when(~known, "new")
        .when(~listed & ~F.col("is_missing"), "missing")
        .when(~listed, "still_missing")
        .when(F.col("is_missing"), "reappeared")
        .when(same, "unchanged")
        .otherwise("modified")
    )
    return (
        scan.join(before, F.col("path") == F.col("known_path"), "full_outer")
        .select(
            F.coalesce("path", "known_path").alias("path"),
            state.alias("state"),
            F.col("was.size_bytes").alias("old_size_bytes"),
            F.col("now.size_bytes").alias("new_size_bytes"),
        )
    )
