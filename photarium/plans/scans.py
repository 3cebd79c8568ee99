"""The three scans as plans: what each would append, given the tables as they are."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.operators import hashing, metadata, observe, reports, worklist
from photarium.operators.latest import active, files_view
from photarium.operators.numbering import largest, number_rows
from photarium.settings import ScanSettings


@dataclass(frozen=True)
class ScanOutput:
    """New rows of one library scan, and its totals."""

    new_master: DataFrame
    new_stats: DataFrame
    totals: DataFrame


def library_scan(
    listing: DataFrame,
    roots: Sequence[str],
    master: DataFrame,
    stats: DataFrame,
    observed_at: Column,
    settings: ScanSettings = ScanSettings(),
) -> ScanOutput:
    """List -> identities -> observations, and missing rows for what is gone.

    ``roots`` are the reachable roots in scan order; ``listing`` is what was found below
    them. Row ids follow (root, present before missing, path), so where two roots hold
    the same path the later root's row is the newer one.
    """
    described = observe.describe(listing, settings)
    created = observe.new_files(described, master)
    identities = master.select("id", "path").unionByName(created)
    columns = ["file_id", "path", "root_order", *observe.CARRIED, "is_missing"]
    present = (
        described.join(identities, "path").withColumn("is_missing", F.lit(False))
        .withColumnRenamed("id", "file_id").select(*columns)
    )
    absent = (
        observe.missing_paths(active(files_view(master, stats)), described, roots)
        .withColumn("is_missing", F.lit(True)).withColumnRenamed("id", "file_id").select(*columns)
    )
    order = ["root_order", "is_missing", "path"]
    rows = number_rows(present.unionByName(absent), order, largest(stats, "stat_id"), "stat_id")
    new_stats = rows.withColumn("observed_at", observed_at).select(*observe.STAT_COLUMNS)
    return ScanOutput(created, new_stats, reports.scan_stats(described))


def metadata_scan(
    master: DataFrame, stats: DataFrame, log: DataFrame, tags: DataFrame, probes: DataFrame,
    extracted_at: Column, key: str = "file_id",
) -> DataFrame:
    """Tag rows for present images and videos that have none yet.

    ``tags`` and ``probes`` are keyed by file_id or by path. The work-list already carries
    each file's latest observation id, so nothing more is joined to stamp the rows.
    """
    work = worklist.needing_metadata(files_view(master, stats), log).withColumnRenamed("id", "file_id")
    needed = work.select(*dict.fromkeys(["file_id", "stat_id", "file_type", key]))
    return metadata.log_rows(metadata.dispatch(needed, tags, probes, key), extracted_at)


@dataclass(frozen=True)
class HashOutput:
    """New hash rows, and the files that could not be hashed."""

    new_hashes: DataFrame
    failures: DataFrame


def hash_work(
    master: DataFrame, stats: DataFrame, hashes: DataFrame, hash_name: str, refresh_stale: bool = False
) -> DataFrame:
    """Files due for ``hash_name``: never hashed, or also changed since, as asked."""
    files = files_view(master, stats)
    scope = worklist.algorithm(hash_name).file_type
    if refresh_stale:
        return worklist.needing_hash_or_stale(files, stats, hashes, hash_name, scope)
    return worklist.needing_hash(files, hashes, hash_name, scope)


def hash_scan(results: DataFrame, stats: DataFrame, computed_at: Column) -> HashOutput:
    """Split computed results into rows for the hash log and failures."""
    stamped = hashing.stamp(hashing.check_names(results), stats)
    return HashOutput(hashing.hash_rows(stamped, computed_at), hashing.quarantine(stamped))
