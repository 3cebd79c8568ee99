"""Latest state over the append-only logs, and the reads built on it.

Every view keeps the newest row per key. Rows of equal time are ordered by ``stat_id``
(then by value), so the answer does not depend on the order of the input. Spark runs
the filter on ``row_number`` as a group limit before the shuffle: each task passes on
one row per key, so a key that holds a third of the log costs no more than another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` columns for each ``keys``."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return (
        df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")
    )


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` columns for each ``keys``; NULL comes last."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return (
        df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")
    )


def latest_stats(stats: DataFrame) -> DataFrame:
    """Newest observation of each file."""
    return newest(stats, ["file_id"], ["observed_at", "stat_id"])


def latest_metadata(metadata: DataFrame) -> DataFrame:
    """Newest value of each (file, namespace, tag)."""
    return newest(
        metadata, ["file_id", "namespace", "tag"], ["extracted_at", "stat_id", "value"]
    )


def latest_hashes(hashes: DataFrame, hash_name: str | None = None) -> DataFrame:
    """Newest hash of each (file, hash name), or of one hash name.

    For one name the filter comes first and the rows are partitioned by file alone, so a
    following join on ``file_id`` needs no further shuffle of this side.
    """
    order = ["computed_at", "stat_id", "hash_value"]
    if hash_name is None:
        return newest(hashes, ["file_id", "hash_name"], order)
    return newest(hashes.filter(F.col("hash_name") == hash_name), ["file_id"], order)


def files_view(master: DataFrame, stats: DataFrame) -> DataFrame:
    """Every file with its path and latest observation.

    The log is cut to one row per file before the join, so the join is one to one.
    """
    return with_paths(master, latest_stats(stats))


def with_paths(master: DataFrame, newest_rows: DataFrame) -> DataFrame:
    """Every file with its path and its row of ``newest_rows``, which has one row per file."""
    return (
        master.join(newest_rows, master["id"] == newest_rows["file_id"])
        .select(
            master["id"], "path", "stat_id", "root_dir", "filename", "extension", "size_bytes",
            "mtime_secs", "mtime_nanos", "file_type", "is_missing", "observed_at",
        )
    )


def active(files: DataFrame) -> DataFrame:
    """Files still present. Apply after the latest state: presence changes over time."""
    return files.filter(~F.col("is_missing"))


def of_type(files: DataFrame, *types: str) -> DataFrame:
    return files.filter(F.col("file_type").isin(*types))


def active_in_root(files: DataFrame, root_dir: str | Column) -> DataFrame:
    """Present files whose latest observation came from ``root_dir`` (compared as text)."""
    root = F.lit(root_dir) if isinstance(root_dir, str) else root_dir
    return active(files).filter(F.col("root_dir") == root).select(
        "id", "path", "size_bytes", "mtime_secs", "mtime_nanos"
    )


def known_paths(files: DataFrame, root_dir: str | None = None) -> DataFrame:
    """Paths of present files with their root, of one root or of all."""
    present = active(files)
    if root_dir is not None:
        present = present.filter(F.col("root_dir") == root_dir)
    return present.select("root_dir", "path")


def latest_stat_ids(stats: DataFrame) -> DataFrame:
    """(file_id, stat_id) of each file's newest observation."""
    return latest_stats(stats.select("file_id", "stat_id", "observed_at")).select("file_id", "stat_id")


def file_exists(probes: DataFrame, master: DataFrame) -> DataFrame:
    """Flag each probed path that was ever catalogued, missing files included."""
    catalogued = master.select("path").withColumn("_known", F.lit(True))
    return (
        probes.select("path").distinct()
        .join(catalogued, "path", "left")
        .select("path", F.coalesce("_known", F.lit(False)).alias("file_exists"))
    )


def file_history(stats: DataFrame, file_id: int | None = None) -> DataFrame:
    """Observations in the order they were made, of one file or file by file.

    The sort covers (file, time, row id), so a file with very many observations is spread
    over several range partitions.
    """
    rows = stats if file_id is None else stats.filter(F.col("file_id") == file_id)
    return rows.orderBy("file_id", "observed_at", "stat_id")
