"""Latest state kept up to date from the observation log as a stream.

``maintain_latest`` keeps a row per file in the stream's state. ``maintain_table`` keeps none: a batch
writes its own newest rows, and the reader or compaction settles them against earlier ones, so the
table itself is all the state there is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from photarium.operators.latest import with_paths
from photarium.streaming import snapshots
from photarium.streaming.snapshots import COMPACT_AFTER, Standing

LATEST = Standing(("observed_at", "stat_id"), largest=True)


def latest_updates(observations: DataFrame) -> DataFrame:
    """The newest observation per file; of a stream, as of each batch.

    Windows are not available on streams, so the newest row is an aggregate. State holds
    one row per file.
    """
    fields = [c for c in observations.columns if c != "file_id"]
    newest_row = F.max_by(F.struct(*fields), F.struct("observed_at", "stat_id")).alias("row")
    return observations.groupBy("file_id").agg(newest_row).select("file_id", "row.*")


def maintain_latest(
    observations: DataFrame, target: str, checkpoint: str, compact_after: int = COMPACT_AFTER
) -> StreamingQuery:
    """Start a query that writes each batch's changed files to its own folder of ``target``."""
    return write_batches(latest_updates(observations), target, checkpoint, ["file_id"], LATEST, compact_after)


def maintain_table(
    observations: DataFrame, target: str, checkpoint: str, compact_after: int = COMPACT_AFTER
) -> StreamingQuery:
    """Start a query that writes each batch's newest row per file, without state; takes what is there and ends.

    A file with very many rows reaches the shuffle as one row of each task.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        snapshots.write_batch(latest_updates(batch), target, batch_id)
        snapshots.compact_when_due(batch.sparkSession, target, ["file_id"], LATEST, compact_after)

    return (
        observations.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )


def write_batches(
    updates: DataFrame, target: str, checkpoint: str, keys: list[str], standing: Standing, compact_after: int = COMPACT_AFTER
) -> StreamingQuery:
    """Start a query that writes each batch's changed rows to its own folder of ``target``.

    A batch that is run again after a failure overwrites its folder, so every change is
    there once. Every ``compact_after`` batches they are folded into a snapshot. The query
    takes what is available now and ends; run it again for more.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        snapshots.write_batch(batch, target, batch_id)
        snapshots.compact_when_due(batch.sparkSession, target, keys, standing, compact_after)

    return (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """The maintained table: for each file its newest observation, from one snapshot and the batches after it."""
    return snapshots.read(spark, target, ["file_id"], LATEST)


def read_files(spark: SparkSession, target: str, master: DataFrame) -> DataFrame:
    """Every file with its path and latest observation, without ranking the log again."""
    return with_paths(master, read_latest(spark, target))
