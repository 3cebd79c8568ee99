"""Joining facts to a table with one row per key when some keys have very many facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def lookup(facts: DataFrame, table: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``facts`` inner-joined to ``table`` on ``key``, the facts of hot keys over many tasks.

    A key with more than ``hot_rows`` facts is hot. Its facts are dealt out over as many
    sub-keys as give each about ``hot_rows``, and its one table row is repeated for each;
    other keys are joined as usual. Only the list of hot keys is broadcast: at most the
    number of facts / ``hot_rows``. The sub-key is a hash of the fact and of its input
    partition, so copies of one fact are dealt out too, and a task that runs again deals
    the same.
    """
    parts = F.ceil(F.col("_facts") / hot_rows).cast("int")
    hot = F.broadcast(
        facts.groupBy(key).agg(F.count(F.lit(1)).alias("_facts"))
        .filter(F.col("_facts") > hot_rows)
        .select(key, parts.alias("_parts"))
    )
    dealt = F.pmod(F.xxhash64(*facts.columns, F.spark_partition_id()), F.col("_parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("_parts") - 1)
    salted_facts = facts.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_parts").isNotNull(), dealt).otherwise(0)
    )
    salted_table = table.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_parts").isNotNull(), every).otherwise(F.array(F.lit(0))))
    )
    return salted_facts.drop("_parts").join(salted_table.drop("_parts"), [key, "_salt"]).drop("_salt")
