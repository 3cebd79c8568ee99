"""Session defaults and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package expects; all can be changed on a live session.
RUNTIME_CONF = {
    # Times in the given tables carry no zone; one fixed zone keeps casts stable.
    "spark.sql.session.timeZone": "UTC",
    # Later duplicates win inside one JSON object, as in most JSON readers.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # State of streams on disk, as it holds a row per file.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``RUNTIME_CONF`` to a session and return it."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder. On a
    cluster a machine-local folder would be lost with its executor, so that is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="photarium-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path under the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    block = _RELEASED.get()
    if block is not None:
        block.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what is at a path of any storage Spark knows; nothing there is no error."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


# Scratch paths to delete at the end of the innermost ``releasing`` block of this thread.
_RELEASED: ContextVar[list[str] | None] = ContextVar("released", default=None)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Delete what is put under new scratch paths inside the block when it ends.

    Blocks of threads that work side by side do not see each other's paths.
    """
    paths: list[str] = []
    outer = _RELEASED.set(paths)
    try:
        yield
    finally:
        _RELEASED.reset(outer)
        for path in paths:
            drop_path(spark, path)


def settle(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder, and read it from there.

    Cuts the lineage like a checkpoint, but later steps read only the columns they need.
    """
    path = path or scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
