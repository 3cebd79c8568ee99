"""Metadata tags: from typed tags and probe documents to rows of the tag log.

A file's tags or probe document is one row until everything that needs a join has been
joined on, and is exploded last. Joins are then one row per file on both sides, however
many tags a file has. The text of a tag is computed after the explode, where Spark
compiles it; inside an array function it would be interpreted. The explodes are outer ones
with a filter behind them: for an inner one Spark adds a size check in front, which would
evaluate the exploded expression - here the parsed document - a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.functions import exif, probe
from photarium.operators.latest import latest_stat_ids, of_type
from photarium.operators.lookup import lookup

ENTRY = ["namespace", "tag", "value"]


def _kept(df: DataFrame, *without: str) -> list[str]:
    return [c for c in df.columns if c not in without]


def exif_rows(tags: DataFrame) -> DataFrame:
    """One row per typed tag of ``tags`` (array of ``functions.exif.TAG_SCHEMA``).

    Other columns are kept; files without tags give no row.
    """
    kept = _kept(tags, "tags")
    one = tags.select(*kept, F.explode_outer("tags").alias("_tag"))
    return one.filter(F.col("_tag").isNotNull()).select(
        *kept,
        exif.namespace(F.col("_tag.ifd")).alias("namespace"),
        F.col("_tag.tag").alias("tag"),
        exif.tag_text(F.col("_tag")).alias("value"),
    )


def _parsed(probes: DataFrame, **parts: Callable[[Column], Column]) -> tuple[DataFrame, list[str]]:
    """Each document's parts as columns, computed once, in place of the document."""
    kept = _kept(probes, "probe_json")
    return probes.select(*kept, *(parse(F.col("probe_json")).alias(name) for name, parse in parts.items())), kept


def _entries(rows: DataFrame, kept: list[str], entries: Column) -> DataFrame:
    """One row per entry that has a value."""
    return rows.select(*kept, F.inline_outer(entries)).filter(F.col("value").isNotNull())


def format_rows(probes: DataFrame) -> DataFrame:
    """Format fields of each ``probe_json``; documents that are no JSON give none."""
    parsed, kept = _parsed(probes, _probe=probe.parse_format)
    return _entries(parsed, kept, probe.format_entries(F.col("_probe.format")))


def format_tag_rows(probes: DataFrame) -> DataFrame:
    """Format tags of each ``probe_json``."""
    parsed, kept = _parsed(probes, _probe=probe.parse_tags, _texts=probe.tag_texts)
    tags = parsed.select(*kept, "_texts", F.explode_outer(probe.tag_values(F.col("_probe.format.tags"))).alias("_tag"))
    value = probe.any_text(F.col("_tag.key"), F.col("_tag.value"), F.col("_texts"))
    return tags.filter(F.col("_tag").isNotNull()).select(
        *kept, F.lit("video_tag").alias("namespace"), F.col("_tag.key").alias("tag"), value.alias("value")
    )


def stream_rows(probes: DataFrame) -> DataFrame:
    """Stream fields of each ``probe_json``."""
    parsed, kept = _parsed(probes, _probe=probe.parse_streams)
    streams = parsed.select(*kept, F.posexplode_outer("_probe.streams").alias("_position", "_stream"))
    return _entries(streams.filter(F.col("_position").isNotNull()), kept, probe.stream_entries(F.col("_stream"), F.col("_position")))


def probe_rows(probes: DataFrame) -> DataFrame:
    """Format fields, format tags and stream fields, each document parsed once.

    A document becomes one row for its format, in the place of an empty stream put in front,
    and one per stream.
    """
    parsed, kept = _parsed(probes, _probe=probe.parse, _texts=probe.tag_texts)
    no_stream = F.array(F.lit(None))
    parts = parsed.select(
        *kept, "_texts", F.col("_probe.format").alias("_format"),
        F.posexplode_outer(F.concat(no_stream, F.coalesce("_probe.streams", F.array()))).alias("_part", "_stream"),
    )
    entries = F.when(
        F.col("_part") == 0,
        F.concat(
            probe.format_entries(F.col("_format")),
            F.coalesce(probe.tag_entries(F.col("_format.tags"), F.col("_texts")), F.array()),
        ),
    ).otherwise(probe.stream_entries(F.col("_stream"), F.col("_part") - 1))
    return _entries(parts, kept, entries)


def dispatch(files: DataFrame, tags: DataFrame, probes: DataFrame, key: str = "file_id") -> DataFrame:
    """Tag rows of files: images by their tags, videos by their probe, others none.

    ``files`` has file_type, ``key`` and columns to keep; ``tags`` and ``probes`` have one
    row per ``key``.
    """
    def joined(kind: str, source: DataFrame) -> DataFrame:
        return of_type(files, kind).drop("file_type").join(source, key)

    return exif_rows(joined("image", tags)).unionByName(probe_rows(joined("video", probes)))


def stamp(rows: DataFrame, stats: DataFrame, row_per_file: bool = True) -> DataFrame:
    """Add each file's latest observation id; files never observed are dropped.

    Results of reading files have one row per file. Rows of single tags, where one file may
    have very many, are joined with ``row_per_file=False``.
    """
    ids = latest_stat_ids(stats)
    return rows.join(ids, "file_id") if row_per_file else lookup(rows, ids, "file_id")


def log_rows(rows: DataFrame, extracted_at: Column) -> DataFrame:
    """Stamped tag rows in the shape of the tag log."""
    return rows.select("file_id", "stat_id", *ENTRY, extracted_at.alias("extracted_at"))
