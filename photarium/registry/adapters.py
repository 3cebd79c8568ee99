"""Catalog tables derived from the given tables.

The given tables hold no media files, so each query reads one of these views of them:

* library: customers are files, every order is an observation of its customer's file and
  one hash of it, every event is a metadata tag
* tree: documents and pages are files with their text as content, listed by two scans;
  a document with a label row is still there at the second
* pictures: embeddings are 8 x 8 gray images
* typed tags from parts, probe documents from orders, run events from events

All are projections or equi-joins of whole tables. ``sql`` holds the same views in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.functions import exif, paths
from photarium.session import configure
from photarium.sources.tables import read_table

# Endings of the invented file names, by the last digit of the file's number.
SUFFIXES = [".JPG", ".png", ".mp4", ".txt", "", ".tar.gz", ".HEIC", ".mkv", ".", ""]
HIDDEN_DIGIT = 9
HASH_NAMES = ["blake3", "content_blake3", "phash", "dhash", "whash"]
NAMESPACES = {
    "view": "exif", "signup": "exif_thumb", "click": "exif_other", "purchase": "video", "error": "video_tag",
}
TREE_ROOTS = ["/lib", "/web", "/lib/src1"]
FIRST_SCAN = "2024-01-01 00:00:00"
SECOND_SCAN = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(configure(spark), f"{sf_dir}/{name}.parquet")


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def pick(values: list[str], index: Column) -> Column:
    """Element of a literal list by 0-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def file_name(number: Column) -> Column:
    digit = number % 10
    plain = F.concat(F.lit("img"), number.cast("string"))
    return F.when(digit == HIDDEN_DIGIT, F.concat(F.lit("."), plain)).otherwise(
        F.concat(plain, pick(SUFFIXES, digit))
    )


def cents(price: str) -> Column:
    return F.round(F.col(price) * 100).cast("long")


def priority_digit() -> Column:
    return F.substring("o_orderpriority", 1, 1).cast("int")


# --- library ---------------------------------------------------------------------------


def library_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("/vol/"), F.lower("c_mktsegment"), F.lit("/"), file_name(F.col("c_custkey"))).alias("path"),
    )


def observations_of(orders: DataFrame) -> DataFrame:
    """Observation rows from orders, batch or streaming."""
    name = file_name(F.col("o_custkey"))
    ext = paths.extension(name)
    moment = F.col("o_orderdate")
    return orders.select(
        F.col("o_orderkey").alias("stat_id"),
        F.col("o_custkey").alias("file_id"),
        F.concat(F.lit("/vol/"), priority_digit().cast("string")).alias("root_dir"),
        name.alias("filename"),
        ext.alias("extension"),
        cents("o_totalprice").alias("size_bytes"),
        paths.mtime_seconds(moment.cast("timestamp")).alias("mtime_secs"),
        F.lit(0).alias("mtime_nanos"),
        paths.file_type(F.coalesce(ext, F.lit(""))).alias("file_type"),
        (F.col("o_orderstatus") == "P").alias("is_missing"),
        moment.alias("observed_at"),
    )


def library_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations_of(table(spark, sf_dir, "orders"))


def hashes_of(orders: DataFrame) -> DataFrame:
    """Hash rows from orders, batch or streaming; some values are NULL."""
    value = (F.floor("o_totalprice") % 500).cast("string")
    return orders.select(
        F.col("o_custkey").alias("file_id"),
        F.col("o_orderkey").alias("stat_id"),
        pick(HASH_NAMES, priority_digit() - 1).alias("hash_name"),
        F.nullif(value, F.lit("0")).alias("hash_value"),
        F.col("o_orderdate").alias("computed_at"),
    )


def library_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashes_of(table(spark, sf_dir, "orders"))


def arrival() -> Column:
    """When an order's row reaches the logs, in four steps: two years each, and every tenth row last of all."""
    step = F.floor((F.year("o_orderdate") - 1995) / 2)
    in_turn = F.greatest(F.lit(0), F.least(F.lit(3), step)).cast("int")
    return F.when(F.col("o_orderkey") % 10 == 0, F.lit(3)).otherwise(in_turn)


def library_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    ns = reduce(
        lambda column, pair: column.when(F.col("event_type") == pair[0], pair[1]), NAMESPACES.items(), F
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"),
        F.col("event_id").alias("stat_id"),
        ns.alias("namespace"),
        F.concat(F.lit("k"), F.substring(k, -1, 1)).alias("tag"),
        k.alias("value"),
        F.col("ts").alias("extracted_at"),
    )


# --- tree ------------------------------------------------------------------------------


def document_path() -> Column:
    return F.concat(
        F.lit("/lib/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), file_name(F.col("doc_id"))
    )


def page_path() -> Column:
    place = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    return F.concat(F.lit("/web/"), place, F.lit("/"), file_name(F.col("page_id")))


def _listing(rows: DataFrame, root_order: int, path: Column, number: str, size: Column) -> DataFrame:
    return rows.select(
        F.lit(TREE_ROOTS[root_order]).alias("root_dir"),
        F.lit(root_order).alias("root_order"),
        path.alias("path"),
        size.cast("long").alias("size_bytes"),
        (F.lit(1_700_000_000) + F.col(number) * 37).cast("long").alias("mtime_secs"),
        ((F.col(number) * 1009) % 1_000_000_000).cast("int").alias("mtime_nanos"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


def full_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, low-quality ones one byte longer, and all pages, under three roots."""
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _listed(spark, sf_dir, table(spark, sf_dir, "documents").join(quality, "doc_id", "left"))


def second_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second scan: labelled documents, low-quality ones one byte longer, and pages.

    The third root lies inside the first, so its files are listed twice.
    """
    return _listed(spark, sf_dir, labelled(spark, sf_dir))


def _listed(spark: SparkSession, sf_dir: str, kept: DataFrame) -> DataFrame:
    size = F.octet_length("text") + F.lit(1) - F.coalesce("quality", F.lit(1))
    pages = table(spark, sf_dir, "pages")
    inner = kept.filter(F.col("source") == "src1")
    return (
        _listing(kept, 0, document_path(), "doc_id", size)
        .unionByName(_listing(pages, 1, page_path(), "page_id", F.octet_length("html")))
        .unionByName(_listing(inner, 2, document_path(), "doc_id", size))
    )


def tree_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities after the first scan, which saw every document."""
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1).alias("id"), document_path().alias("path")
    )


def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the first scan; toxic documents had gone missing after it."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    path = document_path()
    ext = paths.extension(path)
    seen = documents.select(
        (F.col("doc_id") + 1).alias("stat_id"),
        (F.col("doc_id") + 1).alias("file_id"),
        F.lit(TREE_ROOTS[0]).alias("root_dir"),
        paths.filename(path).alias("filename"),
        ext.alias("extension"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        (F.lit(1_700_000_000) + F.col("doc_id") * 37).cast("long").alias("mtime_secs"),
        ((F.col("doc_id") * 1009) % 1_000_000_000).cast("int").alias("mtime_nanos"),
        paths.file_type(F.coalesce(ext, F.lit(""))).alias("file_type"),
        F.lit(False).alias("is_missing"),
        at(FIRST_SCAN).alias("observed_at"),
        "doc_id",
    )
    gone = (
        seen.join(labels.filter(F.col("toxic") == 1), "doc_id")
        .withColumns({
            "stat_id": F.col("stat_id") + 1_000_000_000,
            "is_missing": F.lit(True),
            "observed_at": at(FIRST_SCAN) + F.expr("INTERVAL 1 DAY"),
        })
        .drop("toxic")
    )
    return seen.unionByName(gone).drop("doc_id")


def tree_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("file_id"), F.col("text").alias("content"))


def tree_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents were hashed when the first scan saw them."""
    return labelled(spark, sf_dir).select(
        (F.col("doc_id") + 1).alias("file_id"),
        (F.col("doc_id") + 1).alias("stat_id"),
        F.lit("blake3").alias("hash_name"),
        F.sha2("text", 256).alias("hash_value"),
        at(FIRST_SCAN).alias("computed_at"),
    )


# --- pictures --------------------------------------------------------------------------


def _gray(value: Column) -> Column:
    return F.least(F.greatest(F.floor(value.cast("double") * 256) + 128, F.lit(0)), F.lit(255))


def _image(pixels: Column, across: int = 1, down: int = 1) -> Column:
    """Decoded-image struct of one 8 x 8 gray picture, each pixel repeated ``across`` and ``down``."""
    as_hex = F.transform(pixels, lambda p: F.repeat(F.lpad(F.hex(p), 2, "0"), F.lit(across)))
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda y: F.repeat(F.array_join(F.slice(as_hex, y * 8 + 1, 8), ""), F.lit(down))
    )
    return F.struct(
        F.lit(8 * down).alias("height"), F.lit(8 * across).alias("width"), F.lit(1).alias("nChannels"),
        F.unhex(F.array_join(rows, "")).alias("data"),
    )


def pictures(spark: SparkSession, sf_dir: str, across: int = 1, down: int = 1) -> DataFrame:
    """(file_id, size_bytes, image): every embedding as a picture, exported label + 1 times.

    Exports share the pixels and differ in file size, as re-saved pictures do. A picture is
    8 * ``across`` wide and 8 * ``down`` high.
    """
    copies = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", _gray).alias("pixels"),
        F.explode(F.sequence(F.lit(0), "label")).alias("copy"),
    )
    return copies.select(
        (F.col("vec_id") * 100 + F.col("copy")).alias("file_id"),
        (F.lit(1000) + F.col("vec_id") + F.col("copy")).cast("long").alias("size_bytes"),
        _image(F.col("pixels"), across, down).alias("image"),
    )


def edited_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like ``pictures``, but copy c has its first 2c pixels inverted."""
    copies = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", _gray).alias("pixels"),
        F.explode(F.sequence(F.lit(0), "label")).alias("copy"),
    )
    edited = F.transform(
        "pixels", lambda p, i: F.when(i < F.col("copy") * 2, F.lit(255) - p).otherwise(p)
    )
    return copies.select(
        (F.col("vec_id") * 100 + F.col("copy")).alias("file_id"), "vec_id", "copy", _image(edited).alias("image")
    )


def picture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per exported picture."""
    copies = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), "label")).alias("copy"))
    file_id = F.col("vec_id") * 100 + F.col("copy")
    return copies.select(
        file_id.alias("stat_id"), file_id.alias("file_id"),
        (F.lit(1000) + F.col("vec_id") + F.col("copy")).cast("long").alias("size_bytes"),
        F.lit(False).alias("is_missing"), at(FIRST_SCAN).alias("observed_at"),
    )


# --- typed tags, probes, runs ----------------------------------------------------------


def typed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, tags): a tag of every kind per part."""
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    fields = {
        "ifd": "int", "tag": "string", "kind": "string", "ints": "array<bigint>",
        "ratios": "array<struct<num:bigint,den:bigint>>", "texts": "array<binary>", "raw": "binary",
        "display": "string",
    }

    def tag(ifd: int, name: str, kind: str, **values: Column) -> Column:
        columns = {"ifd": F.lit(ifd), "tag": F.lit(name), "kind": F.lit(kind), **values}
        return F.struct(*[columns.get(f, F.lit(None)).cast(t).alias(f) for f, t in fields.items()])

    def ratio(num: Column, den: Column) -> Column:
        return F.array(F.struct(num.alias("num"), den.alias("den")))

    text = lambda c: F.col(c).cast("binary")
    tags = F.array(
        tag(0, "ISOSpeedRatings", "short", ints=F.array(size)),
        tag(0, "BitsPerSample", "byte", ints=F.array(size, key % 256, F.lit(8).cast("long"))),
        tag(0, "ExposureTime", "rational", ratios=ratio(size, key % 7)),
        tag(1, "XResolution", "rational", ratios=ratio(cents("p_retailprice"), F.lit(100).cast("long"))),
        tag(0, "ExposureBiasValue", "srational", ratios=ratio(size - 25, size - 60)),
        tag(2, "LensSpecification", "rational", display=F.col("p_type"),
            ratios=F.concat(ratio(size, size), ratio(key, size))),
        tag(0, "Make", "ascii", texts=F.array(text("p_brand"), text("p_name"))),
        tag(0, "Model", "ascii", texts=F.array(F.unhex(F.lit("C328")), text("p_name"))),
        tag(0, "Artist", "ascii", texts=F.array(F.unhex(F.lit("FF")))),
        tag(3, "MakerNote", "undefined", raw=text("p_name")),
        tag(0, "UserComment", "undefined", raw=F.repeat("p_type", 10)),
        tag(0, "Gamma", "float", display=F.col("p_name")),
    )
    return table(spark, sf_dir, "part").select(
        key.alias("file_id"), tags.cast(f"array<{exif.TAG_SCHEMA}>").alias("tags")
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, probe_json): one probe document per order, with values of wrong types mixed in.

    By status and priority some documents lack parts, give numbers for text or text for
    numbers, or are cut short.
    """
    status, digit, amount = F.col("o_orderstatus"), priority_digit(), cents("o_totalprice").cast("string")
    duration = (
        F.when(status == "F", F.concat(F.lit('"duration":"'), amount, F.lit('",')))
        .when(status == "O", F.concat(F.lit('"duration":'), amount, F.lit(",")))
        .otherwise("")
    )
    bit_rate = F.when(digit % 2 == 1, F.concat(F.lit('"'), amount, F.lit('"'))).otherwise(amount)
    tags = F.when(digit == 5, "").otherwise(F.concat(
        F.lit(',"tags":{"creation_time":"'), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit('","priority":"'), F.col("o_orderpriority"), F.lit('","cents":'), amount,
        F.lit(',"ratio":2.50,"whole":3.0,"flags":{"a":1,"b":[1,2]},"none":null,"ok":true,"ok":false,'
              '"nested":{"x":3.0,"y":2.50},"list":[1.0]}'),
    ))
    height = F.when(status == "P", '"1080"').otherwise("1080")
    sample_rate = F.when(status == "F", "48000").otherwise('"48000"')
    streams = F.when(digit == 4, '{"codec_type":"video"}').otherwise(F.concat(
        F.lit('[{"codec_type":"video","codec_name":"h264","width":1'), F.substring(amount, -3, 1),
        F.lit('00,"height":'), height, F.lit(',"r_frame_rate":"25/1"},'),
        F.lit('{"codec_type":"audio","codec_name":"aac","width":7,"channels":2,"sample_rate":'), sample_rate,
        F.lit('},{"codec_name":"bin_data","height":5},{"codec_type":"subtitle"}]'),
    ))
    document = F.concat(
        F.lit('{"format":{'), duration, F.lit('"bit_rate":'), bit_rate, F.lit(',"format_name":"mov,mp4"'), tags,
        F.lit('},"streams":'), streams, F.when((status == "P") & (digit == 1), "").otherwise("}"),
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), document.alias("probe_json"))


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, failed = F.col("event_type"), F.col("value") > 50
    event = F.when(kind == "signup", "started").when(kind == "error", "completed").otherwise("progress")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        event.alias("event"),
        F.col("ts").alias("event_time"),
        F.when(event == "started", (F.col("event_id") % 3 + 1).cast("int")).alias("scan_level"),
        F.when(event == "started", pick(HASH_NAMES, F.col("event_id") % 5)).alias("hash_type"),
        F.when(event == "started", F.lit("/vol")).alias("root_dir"),
        F.when(event == "completed", F.when(failed, "failed").otherwise("completed")).alias("status"),
        F.when(event == "progress", F.floor("value")).cast("long").alias("files_processed"),
        F.when(kind == "click", 200).when(kind == "purchase", 0).cast("long").alias("files_total"),
        F.when((event == "completed") & failed, F.concat(F.lit("error "), F.get_json_object("props", "$.k"))).alias("error_message"),
    )
