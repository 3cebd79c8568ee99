"""Entries from a media probe's JSON document (one ``format`` object, one ``streams`` list).

Values are taken only where the JSON type is the expected one: a number where text
belongs, or text where a number belongs, gives no entry. Plain JSON extraction would
convert one into the other, so the leaves are read as VARIANT, which keeps their type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT_FIELDS = ("duration", "bit_rate", "format_name")
STREAM_FIELDS = (
    "codec_type", "codec_name", "width", "height", "r_frame_rate", "sample_rate", "channels",
)

_FORMAT = "format: struct<{}{{}}>".format(", ".join(f"{name}: variant" for name in FORMAT_FIELDS))
_STREAMS = "streams: array<struct<{}>>".format(", ".join(f"{name}: variant" for name in STREAM_FIELDS))
_TAGS = "format: struct<tags: variant>"
_TAG_TEXTS = "format: struct<tags: map<string, string>>"
_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _parsed(document: Column, schema: str) -> Column:
    return F.from_json(F.when(document.rlike(r"^\s*\{"), document), f"struct<{schema}>", _STRICT_JSON)


def parse(document: Column) -> Column:
    """All parts of a document that entries come from; NULL where it is no JSON object."""
    return _parsed(document, f"{_FORMAT.format(', tags: variant')}, {_STREAMS}")


def parse_format(document: Column) -> Column:
    """The format's fields alone, as ``format`` of a struct."""
    return _parsed(document, _FORMAT.format(""))


def parse_tags(document: Column) -> Column:
    """The format's tags alone, as ``format.tags`` of a struct."""
    return _parsed(document, _TAGS)


def parse_streams(document: Column) -> Column:
    """The streams alone, as ``streams`` of a struct."""
    return _parsed(document, _STREAMS)


def tag_texts(document: Column) -> Column:
    """(key, value) for each of the format's tags, with what the value reads like.

    A VARIANT keeps the last of repeated keys and the kind of each value, but not how fractions
    inside of objects and arrays are written; this does.
    """
    return F.map_entries(_parsed(document, _TAG_TEXTS)["format"]["tags"])


def tag_values(tags: Column) -> Column:
    """(key, value) for each of the format's tags, which are a VARIANT."""
    return F.map_entries(tags.try_cast("map<string, variant>"))


def _text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def _integer(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "BIGINT", value.cast("string"))


def _number_text(number: Column) -> Column:
    """A JSON fraction as text: always with a fraction or an exponent."""
    plain = F.regexp_replace(number.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    scientific = F.regexp_replace(F.regexp_replace(number.cast("string"), "E", "e"), r"\.0e", "e")
    size = F.abs(number)
    return F.when((size == 0) | ((size >= 1e-5) & (size < 1e16)), plain).otherwise(scientific)


def any_text(key: Column, value: Column, texts: Column) -> Column:
    """Text values as they are, anything else as JSON text; ``texts`` are the document's ``tag_texts``.

    Objects have their keys in order, unless a fraction is in them: then they stay as written,
    and only then is the tag looked up in ``texts``.
    """
    kind = F.schema_of_variant(value)
    holds_fraction = kind.rlike("^(OBJECT|ARRAY).*(DOUBLE|DECIMAL)")
    is_fraction = (kind == "DOUBLE") | kind.startswith("DECIMAL")
    last = F.try_element_at(F.filter(texts, lambda t: t["key"] == key), F.lit(-1))
    return (
        F.when(kind == "STRING", value.cast("string"))
        .when(is_fraction, _number_text(F.try_variant_get(value, "$", "double")))
        .when(holds_fraction, last["value"])
        .otherwise(F.to_json(value))
    )


def _entry(namespace: str, tag: Column, value: Column) -> Column:
    return F.struct(F.lit(namespace).alias("namespace"), tag.alias("tag"), value.alias("value"))


def format_entries(fmt: Column) -> Column:
    """Duration, bit rate and format name; value NULL where not given as text."""
    return F.array(*[_entry("video", F.lit(name), _text(fmt[name])) for name in FORMAT_FIELDS])


def tag_entries(tags: Column, texts: Column) -> Column:
    """One entry per key of the format's tags object."""
    return F.transform(tag_values(tags), lambda t: _entry("video_tag", t["key"], any_text(t["key"], t["value"], texts)))


def stream_entries(stream: Column, position: Column) -> Column:
    """Codec entries of one stream, and size or sound entries by its kind; absent ones NULL."""

    def entry(name: str, value: Column) -> Column:
        return _entry("video", F.concat(F.lit("stream_"), position.cast("string"), F.lit(f"_{name}")), value)

    codec_type = F.coalesce(_text(stream["codec_type"]), F.lit("unknown"))
    video, audio = codec_type == "video", codec_type == "audio"
    return F.array(
        entry("codec_type", codec_type),
        entry("codec_name", _text(stream["codec_name"])),
        entry("width", F.when(video, _integer(stream["width"]))),
        entry("height", F.when(video, _integer(stream["height"]))),
        entry("frame_rate", F.when(video, _text(stream["r_frame_rate"]))),
        entry("sample_rate", F.when(audio, _text(stream["sample_rate"]))),
        entry("channels", F.when(audio, _integer(stream["channels"]))),
    )
