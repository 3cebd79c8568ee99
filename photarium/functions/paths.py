"""Path expressions: name, extension, type, separators, home folder, mtime."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photarium.settings import ScanSettings


def filename(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the file name.

    NULL where the name has no dot or only a leading one (``.hidden``); empty where the
    name ends in a dot (``foo.``).
    """
    name = filename(path)
    suffix = F.substring_index(name, ".", -1)
    return F.when(F.length(name) - F.length(suffix) > 1, F.lower(suffix))


def file_type(ext: Column, settings: ScanSettings = ScanSettings()) -> Column:
    """'image', 'video' or 'other' by extension, ignoring case; images win."""
    lowered = F.lower(ext)
    return (
        F.when(lowered.isin(*settings.image_extensions), F.lit("image"))
        .when(lowered.isin(*settings.video_extensions), F.lit("video"))
        .otherwise(F.lit("other"))
    )


def forward_slashes(path: Column) -> Column:
    """Path with Windows separators turned into forward slashes."""
    return F.translate(path, "\\", "/")


def expand_home(path: Column, home: str) -> Column:
    """Replace a leading ``~`` component; ``~user`` stays as it is."""
    base = home.rstrip("/") or "/"
    return (
        F.when(path == "~", F.lit(home))
        .when(path.startswith("~/"), F.concat(F.lit(base.rstrip("/")), F.substring(path, 2, 2**31 - 1)))
        .otherwise(path)
    )


def mtime_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch; 0 for times before it or NULL."""
    return F.greatest(F.coalesce(F.unix_seconds(ts), F.lit(0)), F.lit(0)).cast("long")


def mtime_nanos(ts: Column) -> Column:
    """Nanoseconds within the second; 0 for times before the epoch or NULL."""
    micros = F.coalesce(F.unix_micros(ts), F.lit(0))
    return F.when(micros >= 0, (micros % 1_000_000) * 1000).otherwise(F.lit(0)).cast("int")
