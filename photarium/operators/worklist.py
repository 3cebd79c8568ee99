"""Work-lists: which files still need a hash or metadata.

Each is an anti-join from the present files to a log. The log side is reduced to its
distinct file ids first, so a file with very many log rows reaches the join once, and
the join reuses that partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.operators.algorithms import ALGORITHMS, Algorithm, algorithm
from photarium.operators.latest import active, latest_hashes, of_type


WORK = ["id", "path", "size_bytes", "mtime_secs"]


def needing_hash(
    files: DataFrame, hashes: DataFrame, hash_name: str, file_type: str | None = None
) -> DataFrame:
    """Present files without any ``hash_name`` row, as (id, path, size_bytes, mtime_secs).

    A file that changed after it was hashed is not listed; ``needing_hash_or_stale`` is.
    """
    algorithm(hash_name)
    present = active(files)
    if file_type is not None:
        present = of_type(present, file_type)
    hashed = hashes.filter(F.col("hash_name") == hash_name).select(F.col("file_id").alias("id")).distinct()
    return present.join(hashed, "id", "left_anti").select(*WORK)


def without_failures(work: DataFrame, failures: DataFrame, hash_name: str) -> DataFrame:
    """Work-list without the files that could not be decoded in the very version they are in."""
    known = failures.filter(F.col("hash_name") == hash_name).select(
        F.col("file_id").alias("id"), "size_bytes", "mtime_secs"
    ).distinct()
    return work.join(known, ["id", "size_bytes", "mtime_secs"], "left_anti").select(*WORK)


def smallest_first(work: DataFrame) -> DataFrame:
    """Work-list in processing order, for reports; scans spread work by size instead."""
    return work.orderBy("size_bytes", "id")


VERSION = ["size_bytes", "mtime_secs", "mtime_nanos"]


def hashed_versions(stats: DataFrame, hashes: DataFrame, hash_name: str) -> DataFrame:
    """(id, hashed_...): size and mtime at which each file's newest ``hash_name`` was taken."""
    newest = latest_hashes(hashes, hash_name).select("file_id", "stat_id")
    return newest.join(stats.select("stat_id", *VERSION), "stat_id").select(
        F.col("file_id").alias("id"), *[F.col(c).alias(f"hashed_{c}") for c in VERSION]
    )


def needing_hash_or_stale(
    files: DataFrame, stats: DataFrame, hashes: DataFrame, hash_name: str, file_type: str | None = None
) -> DataFrame:
    """Present files never hashed, or changed in size or mtime since their newest hash.

    Compares values, not ``stat_id``: every scan adds a row even if nothing changed.
    """
    algorithm(hash_name)
    present = active(files)
    if file_type is not None:
        present = of_type(present, file_type)
    unchanged = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"hashed_{c}") for c in VERSION])
    return (
        present.join(hashed_versions(stats, hashes, hash_name), "id", "left")
        .filter(~F.coalesce(unchanged, F.lit(False)))
        .select(*WORK)
    )


def needing_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Present images and videos without any metadata row, as (id, path, file_type, stat_id)."""
    done = metadata.select(F.col("file_id").alias("id")).distinct()
    return of_type(active(files), "image", "video").join(done, "id", "left_anti").select(
        "id", "path", "file_type", "stat_id"
    )


def hash_coverage(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Per algorithm: files it applies to, hashed ones, remaining ones.

    The hash log is reduced to one row of flags per file and joined to the files once; all
    counts come from that pass, and an algorithm without rows is reported too.
    """
    flags = hashes.groupBy(F.col("file_id").alias("id")).agg(*[
        F.bool_or(F.col("hash_name") == name).alias(f"has_{name}") for name in ALGORITHMS
    ])
    joined = active(files).select("id", "file_type").join(flags, "id", "left")

    def row(entry: Algorithm) -> list[Column]:
        applies = F.lit(True) if entry.file_type is None else F.col("file_type") == entry.file_type
        done = applies & F.coalesce(F.col(f"has_{entry.name}"), F.lit(False))
        return [F.count_if(applies).alias(f"total_{entry.name}"), F.count_if(done).alias(f"done_{entry.name}")]

    counts = joined.agg(*[column for entry in ALGORITHMS.values() for column in row(entry)])
    rows = [
        F.struct(
            F.lit(name).alias("hash_name"),
            F.col(f"total_{name}").alias("files_total"),
            F.col(f"done_{name}").alias("files_hashed"),
            (F.col(f"total_{name}") - F.col(f"done_{name}")).alias("files_remaining"),
        )
        for name in ALGORITHMS
    ]
    return counts.select(F.inline(F.array(*rows)))
