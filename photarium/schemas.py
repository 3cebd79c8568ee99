"""Table schemas of the catalog.

All tables are append-only. Rows are never updated in place: a change is a new
row, and the current state is the latest row per key (``operators.latest``).
"""

from __future__ import annotations

from pyspark.sql import types as T

FILE_MASTER = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("path", T.StringType(), False),
])

FILE_STATS = T.StructType([
    T.StructField("stat_id", T.LongType(), False),
    T.StructField("file_id", T.LongType(), False),
    T.StructField("root_dir", T.StringType(), False),
    T.StructField("filename", T.StringType(), False),
    T.StructField("extension", T.StringType(), True),
    T.StructField("size_bytes", T.LongType(), False),
    T.StructField("mtime_secs", T.LongType(), False),
    T.StructField("mtime_nanos", T.IntegerType(), False),
    T.StructField("file_type", T.StringType(), False),
    T.StructField("is_missing", T.BooleanType(), False),
    T.StructField("observed_at", T.TimestampType(), False),
])

FILE_METADATA = T.StructType([
    T.StructField("file_id", T.LongType(), False),
    T.StructField("stat_id", T.LongType(), False),
    T.StructField("namespace", T.StringType(), False),
    T.StructField("tag", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
    T.StructField("extracted_at", T.TimestampType(), False),
])

FILE_HASHES = T.StructType([
    T.StructField("file_id", T.LongType(), False),
    T.StructField("stat_id", T.LongType(), False),
    T.StructField("hash_name", T.StringType(), False),
    T.StructField("hash_value", T.StringType(), True),
    T.StructField("computed_at", T.TimestampType(), False),
])

# A file that could not be decoded for a hash, and in which version.
HASH_FAILURES = T.StructType([
    T.StructField("file_id", T.LongType(), False),
    T.StructField("hash_name", T.StringType(), False),
    T.StructField("size_bytes", T.LongType(), False),
    T.StructField("mtime_secs", T.LongType(), False),
    T.StructField("failed_at", T.TimestampType(), False),
])

# One row per step of a run: 'started', 'progress' or 'completed'. The run table a
# user reads is folded from these (plans.runs.run_status).
RUN_EVENTS = T.StructType([
    T.StructField("run_id", T.LongType(), False),
    T.StructField("event", T.StringType(), False),
    T.StructField("event_time", T.TimestampType(), False),
    T.StructField("scan_level", T.IntegerType(), True),
    T.StructField("hash_type", T.StringType(), True),
    T.StructField("root_dir", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("files_processed", T.LongType(), True),
    T.StructField("files_total", T.LongType(), True),
    T.StructField("error_message", T.StringType(), True),
])

# A file found by a scan, before it has an id. ``root_order`` is the position of the
# root in the configured list: the last root to see a path owns it.
LISTING = T.StructType([
    T.StructField("root_dir", T.StringType(), False),
    T.StructField("root_order", T.IntegerType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("size_bytes", T.LongType(), False),
    T.StructField("mtime_secs", T.LongType(), False),
    T.StructField("mtime_nanos", T.IntegerType(), False),
])

TABLES = {
    "file_master": FILE_MASTER,
    "file_stats": FILE_STATS,
    "file_metadata": FILE_METADATA,
    "file_hashes": FILE_HASHES,
    "hash_failures": HASH_FAILURES,
    "run_events": RUN_EVENTS,
}

# Physical partition columns; hash queries always name one algorithm.
PARTITION_COLUMNS = {"file_hashes": ["hash_name"]}


def conform(df, schema: T.StructType):
    """Select ``schema``'s columns in order, cast to its types."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
