"""The run log: events are appended, the run table is folded from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.functions import units
from photarium.operators.lookup import lookup
from photarium.schemas import RUN_EVENTS

STARTED, PROGRESS, COMPLETED = "started", "progress", "completed"
RUNNING = "running"


def run_event(spark: SparkSession, run_id: int, event: str, **values) -> DataFrame:
    """One event row, timed now; values left out are NULL."""
    columns = {f.name: F.lit(values.get(f.name)).cast(f.dataType) for f in RUN_EVENTS}
    columns["run_id"] = F.lit(run_id).cast("long")
    columns["event"] = F.lit(event)
    columns["event_time"] = F.current_timestamp()
    return spark.range(1).select(*[columns[f.name].alias(f.name) for f in RUN_EVENTS])


def run_status(events: DataFrame) -> DataFrame:
    """One row per run: how it started, its newest progress, how it ended.

    Events of a run that was never started change nothing.

    A plain aggregation with partial results per task, so a run with very many progress
    events is reduced before the shuffle. Of progress events with equal times the one
    that got further counts.
    """
    started = F.col("event") == STARTED
    progress = F.col("event") == PROGRESS
    completed = F.col("event") == COMPLETED
    newest_progress = F.max(F.when(progress, F.struct("event_time", "files_processed", "files_total")))
    newest_end = F.max(F.when(completed, F.struct("event_time", "status", "error_message")))
    start = F.min(F.when(started, F.struct("event_time", "scan_level", "hash_type", "root_dir")))
    folded = events.groupBy("run_id").agg(
        start.alias("start"), newest_progress.alias("progress"), newest_end.alias("end")
    )
    return folded.filter(F.col("start").isNotNull()).select(
        F.col("run_id").alias("id"),
        "start.scan_level", "start.hash_type", "start.root_dir",
        F.col("start.event_time").alias("started_at"),
        F.col("end.event_time").alias("completed_at"),
        F.coalesce("end.status", F.lit(RUNNING)).alias("status"),
        F.coalesce("progress.files_processed", F.lit(0)).cast("long").alias("files_processed"),
        F.col("progress.files_total").alias("files_total"),
        F.col("end.error_message").alias("error_message"),
    )


def progress_snapshots(events: DataFrame) -> DataFrame:
    """Every progress event with its run's stage, the percentage done and the time taken.

    ``elapsed_secs`` counts from the start of the run.
    A run with very many events is spread over tasks.
    """
    starts = run_status(events).select(F.col("id").alias("run_id"), "scan_level", "hash_type", "started_at")
    progress = events.filter(F.col("event") == PROGRESS).select(
        "run_id", "event_time", "files_processed", "files_total"
    )
    level = F.col("scan_level")
    stage = F.when(level == 1, "stats").when(level == 2, "metadata").when(level == 3, "hash")
    micros = F.unix_micros(F.col("event_time").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return lookup(progress, starts, "run_id").select(
        "run_id", stage.alias("stage"), "hash_type", "event_time", "files_processed", "files_total",
        units.percent_done(F.col("files_processed"), F.col("files_total")).alias("percent"),
        (micros / F.lit(1e6)).alias("elapsed_secs"),
    )
