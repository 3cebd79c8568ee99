"""Versions of files: the observation log folded into intervals without change.

A version is a run of a file's observations, in the order they were made, that agree in the columns
that make up its state. Runs need the order of a file's rows, and one file may have very many, so a
file with more than ``hot_rows`` observations is cut by time into pieces that are worked on like
files of their own. What is left to do across pieces needs one row of each: whether its first run
goes on from the piece before, and how many versions begin in it. Runs with the same version number
are then put together, which adds up in every task first, and a version meets the one before it by
an equality join on its number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photarium.operators.lookup import HOT_ROWS
from photarium.session import settle

STATE = ["root_dir", "size_bytes", "mtime_secs", "mtime_nanos", "is_missing"]


def _pieces(rows: DataFrame, hot_rows: int) -> DataFrame:
    """``rows`` with ``piece``: 0, or by time for files with more than ``hot_rows`` rows; equal times stay together."""
    second = F.unix_micros(F.col("observed_at").cast("timestamp"))
    hot = (
        rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n"), F.min(second).alias("_from"), F.max(second).alias("_to"))
        .filter(F.col("_n") > hot_rows)
        .select("file_id", "_from", F.ceil(F.col("_n") / hot_rows).alias("_parts"), (F.col("_to") - F.col("_from") + 1).alias("_span"))
    )
    at = F.floor((second - F.col("_from")).cast("double") / F.col("_span") * F.col("_parts"))
    # At most rows / hot_rows files are hot.
    return rows.join(F.broadcast(hot), "file_id", "left").withColumn(
        "piece", F.coalesce(at, F.lit(0)).cast("int")
    ).drop("_n", "_from", "_parts", "_span")


def file_versions(stats: DataFrame, state: Sequence[str] = STATE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per version: ``file_id``, ``version`` (from 1), ``state``'s columns, ``first_seen``, ``last_seen``,
    ``observations``, ``first_stat_id``, and ``size_delta`` against the version before (NULL for the first).

    The order is by time and then by row id. ``size_delta`` compares the sizes of the first
    observations; NULL values of the state are a value of their own.
    """
    now = F.struct(*state)
    rows = _pieces(stats.select("file_id", "stat_id", "observed_at", "size_bytes", now.alias("state")), hot_rows)
    order = Window.partitionBy("file_id", "piece").orderBy("observed_at", "stat_id")
    changed = ~F.lag("state").over(order).eqNullSafe(F.col("state")) | (F.row_number().over(order) == 1)
    run = F.sum(F.when(F.col("_changed"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    when = F.struct("observed_at", "stat_id")
    runs = settle(
        rows.withColumn("_changed", changed).withColumn("run", run).groupBy("file_id", "piece", "run").agg(
            F.min(F.struct("observed_at", "stat_id", "size_bytes", "state")).alias("first"), F.max(when)["observed_at"].alias("last_seen"),
            F.count(F.lit(1)).alias("observations"),
        ), "runs",
    )
    # One row per piece: its first and last state, and how many runs it has.
    ends = runs.groupBy("file_id", "piece").agg(
        F.min_by("first.state", "run").alias("begins"), F.max_by("first.state", "run").alias("ends"), F.max("run").alias("runs")
    )
    by_piece = Window.partitionBy("file_id").orderBy("piece")
    goes_on = F.coalesce(F.lag("ends").over(by_piece).eqNullSafe(F.col("begins")) & F.lag("runs").over(by_piece).isNotNull(), F.lit(False))
    own = F.col("runs") - F.when(F.col("_on"), 1).otherwise(0)
    before = F.coalesce(F.sum(own).over(by_piece.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ends.withColumn("_on", goes_on).select(
        "file_id", "piece", (before - F.when(F.col("_on"), 1).otherwise(0)).alias("_before")
    )
    versions = runs.join(offsets, ["file_id", "piece"]).groupBy("file_id", (F.col("run") + F.col("_before")).cast("bigint").alias("version")).agg(
        F.min("first").alias("first"), F.max("last_seen").alias("last_seen"), F.sum("observations").alias("observations")
    )
    versions = settle(versions, "versions")
    previous = versions.select("file_id", (F.col("version") + 1).alias("version"), F.col("first.size_bytes").alias("_size"))
    return versions.join(previous, ["file_id", "version"], "left").select(
        "file_id", "version", *(F.col(f"first.state.{c}").alias(c) for c in state), F.col("first.observed_at").alias("first_seen"),
        "last_seen", "observations", F.col("first.stat_id").alias("first_stat_id"),
        (F.col("first.size_bytes") - F.col("_size")).alias("size_delta"),
    )
