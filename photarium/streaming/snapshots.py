"""Tables kept by a stream: one folder of changed rows per batch, folded into snapshots now and then.

``target/batch=<n>`` holds the rows that batch n changed, whole rows with the newest content of their
key. ``target/snapshot/<n>-<buckets>`` holds one row per key as of batch n, bucketed and sorted by the
key. A reader takes the newest complete snapshot and the batches after it, so what it reads does not
grow with the age of the table; buckets let the snapshot meet those batches without a shuffle of its
own, when it is read and when the next snapshot is made.

A folder counts once its writer has committed it (``_SUCCESS``), so a snapshot or a batch broken off by
a lost driver is never read; the next attempt overwrites it. Compaction keeps the snapshot before the
new one, and the batches after that, for readers that planned with it; older folders are deleted.

Which row of a key stands is a ``Standing``: the largest or smallest values of some columns win (equal
ones: the snapshot's row, then any), or simply the newest batch. A batch thus need not know what
earlier ones held. Keys and those columns are never NULL, as ``schemas`` states. A target without a committed batch is an error, as it has no columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.operators.latest import earliest, newest
from photarium.session import drop_path


class Standing(NamedTuple):
    """The row of a key with the largest (or smallest) ``columns`` stands."""

    columns: tuple[str, ...]
    largest: bool


NEWEST_BATCH = Standing(("batch",), True)

# Folders of changes a reader may meet before they are folded into a snapshot.
COMPACT_AFTER = 32


def _complete(spark: SparkSession, folder: str) -> list[str]:
    """Names of the committed folders directly below ``folder``; none if it does not exist."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = place(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place(folder)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place(folder)) if s.isDirectory()]
    return [name for name in names if files.exists(place(f"{folder}/{name}/_SUCCESS"))]


def batches(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the committed batches that are still there, ascending."""
    return sorted(int(name[6:]) for name in _complete(spark, target) if name.startswith("batch="))


def snapshots(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """(last batch, number of buckets) of the committed snapshots that are still there, ascending."""
    return sorted(tuple(map(int, name.split("-"))) for name in _complete(spark, f"{target}/snapshot"))


def write_batch(batch: DataFrame, target: str, batch_id: int) -> None:
    """Write the rows a batch changed; a batch that is run again overwrites its folder."""
    batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def _suffix(
    spark: SparkSession, target: str, keys: Sequence[str], numbers: Sequence[int], standing: Standing
) -> DataFrame:
    rows = spark.read.option("basePath", target).parquet(*[f"{target}/batch={n}" for n in numbers])
    pick = newest if standing.largest else earliest
    return pick(rows, keys, standing.columns).drop("batch")


def _table_name(target: str, number: int, buckets: int) -> str:
    return f"snapshot_{hashlib.sha256(f'{target}/{number}-{buckets}'.encode()).hexdigest()[:32]}"


def _snapshot(spark: SparkSession, target: str, keys: Sequence[str], number: int, buckets: int) -> DataFrame:
    """A snapshot with its buckets. The name is only this session's handle; the files say which bucket they hold."""
    name, path = _table_name(target, number, buckets), f"{target}/snapshot/{number}-{buckets}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        by = ", ".join(f"`{key}`" for key in keys)
        spark.sql(
            f"CREATE TABLE `{name}` ({columns}) USING parquet "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def _fold(snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], standing: Standing) -> DataFrame:
    """``snapshot`` with the rows of ``changes`` that stand against its own, partitioned like the snapshot."""
    fields = [c for c in snapshot.columns if c not in keys]
    old = snapshot.select(*keys, F.struct(*fields).alias("_old"))
    new = changes.select(*keys, F.struct(*fields).alias("_new"))
    row = F.coalesce("_new", "_old")
    if standing != NEWEST_BATCH:
        was, now = (F.struct(*[F.col(f"{side}.{c}") for c in standing.columns]) for side in ("_old", "_new"))
        stays = F.col("_new").isNull() | (was >= now if standing.largest else was <= now)
        row = F.when(F.col("_old").isNotNull() & stays, F.col("_old")).otherwise(F.col("_new"))
    return old.join(new, list(keys), "full_outer").select(*keys, row.alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in fields]
    )


def read(spark: SparkSession, target: str, keys: Sequence[str], standing: Standing = NEWEST_BATCH) -> DataFrame:
    """For each key its row as of the last committed batch: the newest snapshot and the batches after it."""
    last, buckets = (snapshots(spark, target) or [(-1, 0)])[-1]
    after = [n for n in batches(spark, target) if n > last]
    if last < 0:
        return _suffix(spark, target, keys, after, standing)
    base = _snapshot(spark, target, keys, last, buckets)
    return _fold(base, _suffix(spark, target, keys, after, standing), keys, standing) if after else base


def compact(
    spark: SparkSession, target: str, keys: Sequence[str], standing: Standing = NEWEST_BATCH, buckets: int | None = None
) -> int:
    """Fold the newest snapshot and the batches after it into a new one; the last batch it holds (-1: none).

    ``buckets`` is the number of files of the first snapshot (as many as the session's shuffle
    partitions, if not given); later ones keep it, unless another is given, which shuffles them once.
    """
    known = snapshots(spark, target)
    last, before = known[-1] if known else (-1, 0)
    after = [n for n in batches(spark, target) if n > last]
    if not after:
        return last
    number = after[-1]
    buckets = buckets or before or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = read(spark, target, keys, standing)
    if before != buckets:
        rows = rows.repartition(buckets, *keys)
    name = _table_name(target, number, buckets)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    (
        rows.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
        .option("path", f"{target}/snapshot/{number}-{buckets}").saveAsTable(name)
    )
    for old, parts in known[:-1]:
        spark.sql(f"DROP TABLE IF EXISTS `{_table_name(target, old, parts)}`")
        drop_path(spark, f"{target}/snapshot/{old}-{parts}")
    for old in batches(spark, target):
        if old <= last:
            drop_path(spark, f"{target}/batch={old}")
    return number


def compact_when_due(
    spark: SparkSession, target: str, keys: Sequence[str], standing: Standing = NEWEST_BATCH, after: int = COMPACT_AFTER
) -> None:
    """Compact if there are ``after`` batches or more since the last snapshot."""
    last = (snapshots(spark, target) or [(-1, 0)])[-1][0]
    if sum(n > last for n in batches(spark, target)) >= after:
        compact(spark, target, keys, standing)
