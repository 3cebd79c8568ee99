"""Two-pass external shuffle into shards.

Pass one scatters records into buckets by seeded hashes; a shard's buckets are so many that
one fits into a task's memory. Pass two shuffles each bucket by Fisher and Yates and numbers
the records behind those of the shard's earlier buckets. A text crosses the network once.

The shard of a record is the one with the highest seeded hash of (id, shard number), so an id
and the number of shards decide it, and one more shard only takes records into itself.

Nulls and repeats: null ids are one id, a null text counts no bytes, rows alike in id and text
get neighbouring slots of one bucket in any order. An empty table gives an empty result. A very long
text makes its bucket longer by itself. Given columns may have any name; ``shard`` and ``slot`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from photarium.llm.common import settle

SHARDS = 16
SEED = 23
# Bytes of text in a bucket, on average.
BUCKET_BYTES = 16 << 20
# Buckets that a task shuffles, one after the other.
TASK_BUCKETS = 4
LAW = "key"


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash of (seed, id, shard); the lowest such shard."""
    scores = F.array(*(F.xxhash64(F.lit(seed), doc_id, F.lit(s)) for s in range(shards)))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _shuffled(seed: int):
    def shuffle(table: pa.Table) -> pa.Table:
        """One bucket: a fixed order of its records, then a seeded Fisher-Yates shuffle of it."""
        fixed = table.sort_by([("_mix", "ascending"), ("_id_text", "ascending")])
        shard, bucket = fixed.column("shard")[0].as_py(), fixed.column("_bucket")[0].as_py()
        places = np.random.default_rng([seed, shard, bucket]).permutation(fixed.num_rows)
        moved = fixed.take(pa.array(places))
        slot = pa.array(np.arange(fixed.num_rows, dtype=np.int64) + fixed.column("_start")[0].as_py())
        return moved.select(["shard", "_given"]).append_column("slot", slot)

    return shuffle


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot``, gapless from 0 in each shard."""
    given = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in given)).alias("_given"), shard_of(F.col("doc_id"), shards, seed).alias("shard"),
        F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text")).alias("_mix"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id_text"),
    )
    size = F.coalesce(F.octet_length("_given.text"), F.lit(0)) + 1
    totals = rows.groupBy("shard").agg(F.sum(size).alias("_bytes"))
    buckets = settle(
        totals.select("shard", F.ceil(F.col("_bytes") / bucket_bytes).cast("int").alias("_buckets")), "shard-buckets"
    )
    scattered = rows.join(F.broadcast(buckets), "shard").withColumn(  # one row per shard
        "_bucket", F.pmod(F.xxhash64(F.lit(seed + 2), F.col("_mix")), F.col("_buckets")).cast("int")
    ).drop("_buckets")
    counts = scattered.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(counts.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")), "shard-starts")
    # The texts cross the network here, once, into as many tasks as the buckets ask for.
    tasks = -(-starts.count() // TASK_BUCKETS)
    placed = scattered.repartition(max(1, tasks), "shard", "_bucket").join(starts, ["shard", "_bucket"])
    kept = [placed.schema[name] for name in ("shard", "_given")]
    moved = placed.groupBy("shard", "_bucket").applyInArrow(_shuffled(seed), StructType(kept).add("slot", LongType()))
    return moved.select(*(F.col(f"_given.`{c}`") for c in given), "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write shards as folders ``shard=N``; the column ``slot`` keeps the order."""
    sharded.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shards of all documents, with each text's size and checksum in place of the text."""
    sharded = shuffle_into_shards(docs.select("doc_id", "text"), shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharded.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot", shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
