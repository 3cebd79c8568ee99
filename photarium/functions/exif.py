"""Text form of typed tag values.

A tag value arrives as a struct with the fields of ``TAG_SCHEMA``; ``kind`` says which
of the arrays holds it. ``display`` is the reader's own rendering, used for kinds and
lengths that have no rule here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG_SCHEMA = (
    "struct<ifd:int, tag:string, kind:string, ints:array<bigint>, "
    "ratios:array<struct<num:bigint,den:bigint>>, texts:array<binary>, "
    "raw:binary, display:string>"
)

INTEGER_KINDS = ("byte", "short", "long")
RATIO_KINDS = ("rational", "srational")
RAW_BYTES_SHOWN = 64

# Wide enough for every quotient of two 32-bit numbers without rounding: up to ten digits
# before the point, and 17 significant digits down to 1/4294967295 after it.
_QUOTIENT = "decimal(38,28)"


def namespace(ifd: Column) -> Column:
    """Directory number to namespace: 0 main picture, 1 thumbnail, others."""
    return F.when(ifd == 0, "exif").when(ifd == 1, "exif_thumb").otherwise("exif_other")


def list_text(values: Column) -> Column:
    """``[a, b, c]``."""
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))


def integers_text(values: Column) -> Column:
    """A single number plain, any other count as a list."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)).cast("string")).otherwise(list_text(values))


def decimal_text(value: Column) -> Column:
    """A double in plain decimal notation: fewest digits, no exponent, no trailing zeros.

    Sixteen digits are used where they read back as the same number; the default text form
    of some Java versions gives one more. Numbers too large for a tag's 32-bit parts keep
    their default form.
    """
    short = F.format_string("%.15e", value)
    digits = F.when(short.try_cast("double") == value, short).otherwise(value.cast("string"))
    plain = F.regexp_replace(digits.try_cast(_QUOTIENT).cast("string"), r"\.?0+$", "")
    return F.coalesce(plain, value.cast("string"))


def ratio_text(ratio: Column) -> Column:
    """Quotient as decimal text, or ``num/den`` where the denominator is 0."""
    num, den = ratio["num"], ratio["den"]
    quotient = num.cast("double") / F.nullif(den, F.lit(0)).cast("double")
    return (
        F.when(den == 0, F.concat_ws("/", num.cast("string"), den.cast("string")))
        .when((num == 0) & (den < 0), F.lit("-0"))
        .when(num == 0, F.lit("0"))
        .otherwise(decimal_text(quotient))
    )


def ascii_text(texts: Column) -> Column:
    """Valid UTF-8 parts joined with a comma; NULL where nothing is left."""
    valid = F.filter(texts, lambda t: F.is_valid_utf8(t.cast("string")))
    return F.nullif(F.array_join(valid.cast("array<string>"), ", "), F.lit(""))


def raw_text(raw: Column) -> Column:
    """Short byte strings as a list of numbers, long ones as their length."""
    digits = F.hex(raw)
    as_numbers = F.when(
        F.length(raw) > 0,
        F.transform(
            F.sequence(F.lit(0), F.length(raw) - 1),
            lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(raw) <= RAW_BYTES_SHOWN, list_text(as_numbers)).otherwise(
        F.concat(F.lit("["), F.length(raw).cast("string"), F.lit(" bytes]"))
    )


def tag_text(tag: Column) -> Column:
    """Text of one tag value by its kind."""
    kind = tag["kind"]
    return (
        F.when(kind.isin(*INTEGER_KINDS), integers_text(tag["ints"]))
        .when(
            kind.isin(*RATIO_KINDS) & (F.size(tag["ratios"]) == 1),
            ratio_text(F.get(tag["ratios"], F.lit(0))),
        )
        .when(kind == "ascii", ascii_text(tag["texts"]))
        .when(kind == "undefined", raw_text(tag["raw"]))
        .otherwise(tag["display"])
    )
