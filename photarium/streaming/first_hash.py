"""First hash per file and algorithm, kept up to date from the hash log as a stream.

Two forms. ``maintain_first`` keeps a row per key in the stream's state for ever. ``maintain_bounded``
keeps no state: a batch writes its own earliest rows and the reader (or compaction) settles them
against earlier ones. A row that comes later than a bound allows goes to a table of late rows
instead, where it can be looked at; Spark's watermark would drop it without a trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from photarium.operators.latest import earliest
from photarium.streaming import snapshots
from photarium.streaming.latest_state import write_batches
from photarium.streaming.snapshots import COMPACT_AFTER, Standing

KEYS = ["file_id", "hash_name"]
ORDER = ["computed_at", "stat_id"]
FIRST = Standing(tuple(ORDER), largest=False)


def first_hashes(hashes: DataFrame) -> DataFrame:
    """Streaming: the earliest row per (file_id, hash_name), as of each batch.

    An aggregate with partial results per task, so a key with very many rows reaches the
    shuffle as one row of each task. State holds one row per key.
    """
    fields = [c for c in hashes.columns if c not in KEYS]
    earliest = F.min_by(F.struct(*fields), F.struct(*ORDER)).alias("row")
    return hashes.groupBy(*KEYS).agg(earliest).select(*KEYS, "row.*")


def maintain_first(hashes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Start a query that writes each batch's changed keys below ``target``, takes what is there and ends."""
    return write_batches(first_hashes(hashes), target, checkpoint, KEYS, FIRST)


def read_first(spark: SparkSession, target: str) -> DataFrame:
    """The maintained table: for each key its earliest row."""
    return snapshots.read(spark, target, KEYS, FIRST)


def _marks(spark: SparkSession, target: str, numbers: list[int]) -> DataFrame:
    """Marks of batches of ``maintain_bounded``: newest time up to and with the batch, rows, late rows."""
    return spark.read.option("basePath", f"{target}/mark").parquet(*[f"{target}/mark/batch={n}" for n in numbers])


def maintain_bounded(
    hashes: DataFrame, target: str, checkpoint: str, bound: str, compact_after: int = COMPACT_AFTER
) -> StreamingQuery:
    """Start a query that keeps first hashes without state; it takes what is there and ends.

    ``bound`` is an interval like ``7 DAYS``. A row is late if its time lies more than that before
    the newest time of all earlier batches; rows of one batch do not make each other late. What a
    batch does depends on its rows and the marks of earlier batches alone, so one that is run again
    after a failure writes the same again. Its mark is written last. Rows without a time are late.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [n for n in snapshots.batches(spark, f"{target}/mark") if n < batch_id]
        newest = _marks(spark, target, before[-1:]).first()["newest"] if before else None
        batch.persist()
        try:
            time = F.col("computed_at")
            # The first batch has no bound; a missing time cannot be placed.
            late = time.isNull()
            if newest is not None:
                late = late | (time < F.lit(newest).cast(batch.schema["computed_at"].dataType) - F.expr(f"INTERVAL {bound}"))
            snapshots.write_batch(first_hashes(batch.filter(~late)), target, batch_id)
            snapshots.write_batch(batch.filter(late), f"{target}/late", batch_id)
            mark = batch.agg(
                F.greatest(F.max(time), F.lit(newest).cast(batch.schema["computed_at"].dataType)).alias("newest"),
                F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late_rows"),
            )
            snapshots.write_batch(mark, f"{target}/mark", batch_id)
        finally:
            batch.unpersist()
        snapshots.compact_when_due(spark, target, KEYS, FIRST, compact_after)

    return (
        hashes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )


def read_bounded(spark: SparkSession, target: str) -> DataFrame:
    """The maintained table of ``maintain_bounded``: the earliest row of each key among those in time."""
    return snapshots.read(spark, target, KEYS, FIRST)


def read_late(spark: SparkSession, target: str) -> DataFrame:
    """All rows that came too late, with the batch they came in."""
    names = snapshots.batches(spark, f"{target}/late")
    return spark.read.option("basePath", f"{target}/late").parquet(*[f"{target}/late/batch={n}" for n in names])


def late_counts(spark: SparkSession, target: str) -> DataFrame:
    """Rows and late rows of each batch."""
    return _marks(spark, target, snapshots.batches(spark, f"{target}/mark")).select("batch", "rows", "late_rows")


def read_with_late(spark: SparkSession, target: str) -> DataFrame:
    """First hashes of all rows, late ones included: what a batch job over the whole log gives."""
    timed = read_late(spark, target).filter(F.col("computed_at").isNotNull()).drop("batch")
    return earliest(read_bounded(spark, target).unionByName(timed), KEYS, ORDER)
