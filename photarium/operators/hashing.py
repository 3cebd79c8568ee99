"""Hash results: computing them, checking names, splitting rows from failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.functions import errors
from photarium.operators.algorithms import ALGORITHMS, algorithm
from photarium.operators.latest import latest_stat_ids


def compute(contents: DataFrame, hash_name: str, source: str = "content") -> DataFrame:
    """(file_id, hash_name, hash_value, error_code, error_message) for one algorithm.

    ``contents`` has file_id and the column the algorithm needs (bytes, RGBA pixels or
    grid). It may carry error_code and error_message from reading; a row without content
    and without its own error is a decode failure.
    """
    method = algorithm(hash_name)
    value = method.compute(F.col(source))
    own_code = F.col("error_code") if "error_code" in contents.columns else F.lit(None).cast("string")
    own_text = F.col("error_message") if "error_message" in contents.columns else F.lit(None).cast("string")
    failed = F.col("hash_value").isNull()
    message = errors.error_text(
        F.lit(errors.HASH_DECODE_FAILED), F.lit("file_id"), F.col("file_id").cast("string"), F.lit("no content")
    )
    return (
        contents.select("file_id", value.alias("hash_value"), own_code.alias("_code"), own_text.alias("_text"))
        .select(
            "file_id",
            F.lit(hash_name).alias("hash_name"),
            "hash_value",
            F.when(failed, F.coalesce("_code", F.lit(errors.HASH_DECODE_FAILED))).alias("error_code"),
            F.when(failed, F.coalesce("_text", message)).alias("error_message"),
        )
    )


def check_names(results: DataFrame) -> DataFrame:
    """Give rows with an unregistered hash name an error; keep all others as they are."""
    if "error_code" not in results.columns:
        results = results.withColumns({
            "error_code": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string"),
        })
    unknown = ~F.coalesce(F.col("hash_name").isin(list(ALGORITHMS)), F.lit(False))
    message = errors.error_text(
        F.lit(errors.HASH_UNKNOWN_ALGORITHM), F.lit("algorithm"), F.col("hash_name"), F.lit(None)
    )
    return results.withColumns({
        "error_code": F.when(unknown, errors.HASH_UNKNOWN_ALGORITHM).otherwise(F.col("error_code")),
        "error_message": F.when(unknown, message).otherwise(F.col("error_message")),
    })


def stamp(results: DataFrame, stats: DataFrame) -> DataFrame:
    """Add each file's latest observation id; a result of a file never observed gets an error.

    Results hold one row per file and algorithm.
    """
    unknown = F.col("stat_id").isNull() & F.col("error_code").isNull()
    message = errors.error_text(
        F.lit(errors.SET_HASH_FAILED), F.lit("file_id"), F.col("file_id").cast("string"), F.lit("never observed")
    )
    return results.join(latest_stat_ids(stats), "file_id", "left").withColumns({
        "error_code": F.when(unknown, errors.SET_HASH_FAILED).otherwise(F.col("error_code")),
        "error_message": F.when(unknown, message).otherwise(F.col("error_message")),
    })


def hash_rows(stamped: DataFrame, computed_at: Column) -> DataFrame:
    """Rows for the hash log from stamped results without error.

    Failures are left out, so the next scan lists their files again.
    """
    return stamped.filter(F.col("error_code").isNull()).select(
        "file_id", "stat_id", "hash_name", "hash_value", computed_at.alias("computed_at")
    )


def quarantine(results: DataFrame) -> DataFrame:
    """Results that failed, with their error code and text."""
    return results.filter(F.col("error_code").isNotNull()).select(
        "file_id", "hash_name", "error_code", "error_message"
    )
