"""64-bit fingerprints: building them from comparisons, storing and comparing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances below this mean "likely the same picture".
SAME_PICTURE_BELOW = 10


def pack(bits: Column) -> Column:
    """An array of up to 64 booleans as one signed 64-bit number, first one lowest.

    Missing high bits are 0. Written with array functions: 64 unrolled terms would exceed
    what the JVM compiles as one method and run slower.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    weights = F.transform(bits, lambda bit, i: F.when(bit, F.call_function("shiftleft", one, i)).otherwise(zero))
    return F.aggregate(weights, zero, lambda acc, weight: acc.bitwiseOR(weight))


def hamming(left: Column, right: Column) -> Column:
    """Number of differing bits of two 64-bit fingerprints."""
    return F.bit_count(left.bitwiseXOR(right))


def same_picture(distance: Column) -> Column:
    """'identical', 'likely_same' or 'different'."""
    return (
        F.when(distance == 0, "identical")
        .when(distance < SAME_PICTURE_BELOW, "likely_same")
        .otherwise("different")
    )


def to_text(value: Column) -> Column:
    """Stored form of a fingerprint: decimal text."""
    return value.cast("string")


def from_text(value: Column) -> Column:
    """Fingerprint from its stored text; NULL where the text is no 64-bit number."""
    return value.try_cast("long")
