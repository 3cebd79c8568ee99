"""Report arithmetic: size units, wasted space, digest prefixes, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1024.0 ** 3
MIB = 1024.0 ** 2
DIGEST_PREFIX = 16


def gib(size_bytes: Column) -> Column:
    return F.round(size_bytes / F.lit(GIB), 2)


def mib(size_bytes: Column) -> Column:
    return F.round(size_bytes / F.lit(MIB), 2)


def wasted_bytes(total_size: Column, copies: Column) -> Column:
    """Space that keeping one average-sized copy of a group would free."""
    total = total_size.cast("double")
    return total - total / copies.cast("double")


def digest_prefix(digest: Column) -> Column:
    return F.substring(digest, 1, DIGEST_PREFIX)


def percent_done(processed: Column, total: Column) -> Column:
    """Whole percent, rounded down; 0 for an empty total, NULL for an unknown one."""
    return F.when(
        total.isNotNull(),
        F.when(total > 0, F.floor(processed.cast("double") / total.cast("double") * 100)).otherwise(0),
    ).cast("int")
