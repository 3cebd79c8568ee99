"""Operators on small tables: edge cases, and results that must not depend on row order."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from photarium.functions import bits, errors, exif, paths, units
from photarium.operators import fingerprints, hashing, latest, metadata, observe, reports, similarity
from photarium.operators.algorithms import ALGORITHMS, Algorithm, algorithm, register
from photarium.operators.lookup import lookup
from photarium.operators.numbering import number_rows
from photarium.settings import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, ScanSettings
from photarium.sources import media
from photarium.streaming import first_hash, latest_state


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- paths and settings ----------------------------------------------------------------


def test_extension_and_type(spark):
    expected = {
        "/p/a.JPG": ("jpg", "image"), "/p/b.Png": ("png", "image"), "/p/c.MP4": ("mp4", "video"),
        "/p/d.mkv": ("mkv", "video"), "/p/e.txt": ("txt", "other"), "/p/.hidden": (None, "other"),
        "/p/foo.": ("", "other"), "/p/noext": (None, "other"), "/p/a.tar.gz": ("gz", "other"),
        "/p.d/noext": (None, "other"), "/p/..jpg": ("jpg", "image"), "/p/a\nb.jpg": ("jpg", "image"),
    }
    df = spark.createDataFrame([(p,) for p in expected], "path string")
    listing = df.select("path", paths.extension(F.col("path")).alias("e")).withColumn(
        "t", paths.file_type(F.coalesce("e", F.lit("")))
    )
    assert {r["path"]: (r["e"], r["t"]) for r in listing.collect()} == expected


def test_image_list_wins_and_lists_are_configurable(spark):
    custom = ScanSettings(image_extensions=("x", "y"), video_extensions=("y", "z"))
    df = spark.createDataFrame([("X",), ("y",), ("Z",), ("jpg",)], "e string")
    assert [r[0] for r in df.select(paths.file_type(F.col("e"), custom)).collect()] == ["image", "image", "video", "other"]


def test_settings_defaults_and_round_trip():
    assert len(IMAGE_EXTENSIONS) == 20 and len(VIDEO_EXTENSIONS) == 12
    assert ScanSettings.from_dict(None) == ScanSettings.from_dict({}) == ScanSettings()
    partial = ScanSettings.from_dict({"schema_version": 1, "scan": {"roots": ["/a"], "level2": {"x": 1}}})
    assert partial.roots == ("/a",) and partial.image_extensions == IMAGE_EXTENSIONS
    changed = ScanSettings().with_roots("D:\\pics\\one", "/two")
    assert changed.roots == ("D:/pics/one", "/two")
    assert ScanSettings.from_dict(json.loads(json.dumps(changed.to_dict()))) == changed


def test_home_and_windows_paths(spark):
    df = spark.createDataFrame([("~",), ("~/a/b",), ("~user/a",), ("/x/~",)], "p string")
    assert [r[0] for r in df.select(paths.expand_home(F.col("p"), "/home/me/")).collect()] == [
        "/home/me/", "/home/me/a/b", "~user/a", "/x/~"]
    df = spark.createDataFrame([("C:\\a\\b.jpg",)], "p string")
    assert df.select(paths.forward_slashes(F.col("p"))).first()[0] == "C:/a/b.jpg"


def test_mtime_before_epoch_is_zero(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (timestamp'1970-01-01 00:00:01.5'), (timestamp'1969-12-31 23:59:59.5'), "
        "(timestamp'2024-01-01 00:00:00.000123'), (CAST(NULL AS timestamp)) t(m)"
    )
    assert values(df, paths.mtime_seconds(F.col("m")), paths.mtime_nanos(F.col("m"))) == [
        (1, 500_000_000), (0, 0), (1704067200, 123_000), (0, 0)]


def test_units(spark):
    row = spark.range(1).select(
        units.gib(F.lit(3 * 1024**3)), units.mib(F.lit(1024**2)), units.wasted_bytes(F.lit(300), F.lit(3)),
        units.digest_prefix(F.lit("0123456789abcdefXYZ")), units.percent_done(F.lit(199), F.lit(200)),
        units.percent_done(F.lit(5), F.lit(0)), units.percent_done(F.lit(5), F.lit(None).cast("long")),
    ).first()
    assert tuple(row) == (3.0, 1.0, 200.0, "0123456789abcdef", 99, 0, None)


def test_error_text_leaves_out_missing_parts(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(
        errors.error_text(F.lit("IO_ERROR"), F.lit("path"), F.lit("/p"), F.lit("gone")),
        errors.error_text(F.lit("A"), F.lit("path"), F.lit("/p"), none), errors.error_text(F.lit("A"), none, none, F.lit("x")),
        errors.error_text(F.lit("A"), none, none, none),
    ).first()
    assert tuple(row) == ("IO_ERROR. path: /p (gone)", "A. path: /p", "A (x)", "A")


# --- fingerprints ----------------------------------------------------------------------


def signed(bit_list):
    value = sum(1 << i for i, b in enumerate(bit_list) if b)
    return value - (1 << 64) if value >= 1 << 63 else value


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.integers(0, 255), min_size=72, max_size=72), min_size=1, max_size=5))
def test_fingerprints_match_plain_code(spark, grids):
    df = spark.createDataFrame([(i, [float(v) for v in g]) for i, g in enumerate(grids)], "i int, g array<double>")
    row8, row5 = F.slice("g", 1, 64), F.slice("g", 1, 25)
    found = df.select(
        "i", fingerprints.mean_hash(row8, 8, 8), fingerprints.gradient_hash(F.col("g"), 9, 8),
        fingerprints.double_gradient_hash(row5, 5, 5),
    ).collect()
    for i, mean, gradient, double in found:
        g = grids[i]
        assert mean == signed([v * 64 >= sum(g[:64]) for v in g[:64]])
        assert gradient == signed([g[y * 9 + x] < g[y * 9 + x + 1] for y in range(8) for x in range(8)])
        across = [g[y * 5 + x] < g[y * 5 + x + 1] for y in range(5) for x in range(4)]
        down = [g[y * 5 + x] < g[y * 5 + x + 5] for y in range(4) for x in range(5)]
        assert double == signed(across + down) and 0 <= double < 1 << 40


def test_short_grid_has_no_fingerprint(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "g array<double>")
    assert df.select(fingerprints.mean_hash(F.col("g"), 8, 8)).first()[0] is None


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(-2**63, 2**63 - 1), st.integers(-2**63, 2**63 - 1)), min_size=1, max_size=20))
def test_hamming_is_symmetric_and_counts_bits(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    for a, b, ab, ba in df.select("a", "b", bits.hamming(F.col("a"), F.col("b")), bits.hamming(F.col("b"), F.col("a"))).collect():
        assert ab == ba == bin((a ^ b) & (2**64 - 1)).count("1")


def test_fingerprint_text(spark):
    df = spark.createDataFrame([("-9223372036854775808",), ("12",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(bits.from_text(F.col("t"))).collect()] == [-2**63, 12, None, None]


def test_area_mean():
    gray = np.arange(64, dtype=float).reshape(8, 8)
    assert np.array_equal(media.area_mean(gray, 8, 8), gray)
    assert np.allclose(media.area_mean(gray, 4, 4), gray.reshape(4, 2, 4, 2).mean(axis=(1, 3)))
    for width, height in ((9, 8), (5, 5), (3, 7)):
        assert np.isclose(media.area_mean(gray, width, height).mean(), gray.mean())


def test_registering_an_algorithm(spark):
    try:
        register(Algorithm("crc", "bytes", lambda c: F.crc32(c).cast("string")))
        contents = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "file_id long, content binary")
        rows = {r["file_id"]: r for r in hashing.compute(contents, "crc").collect()}
        assert rows[1]["hash_value"] == "891568578" and rows[1]["error_code"] is None
        assert rows[2]["error_code"] == errors.HASH_DECODE_FAILED
        assert algorithm("crc").name in ALGORITHMS
    finally:
        ALGORITHMS.pop("crc")
    with pytest.raises(errors.UnknownAlgorithm):
        algorithm("crc")


def test_given_pairs_are_all_compared(spark):
    prints = [(i, i, "phash", str(i), dt.datetime(2024, 1, 1)) for i in range(50)]
    log = spark.createDataFrame(prints, "file_id long, stat_id long, hash_name string, hash_value string, computed_at timestamp")
    pair_list = [(0, i) for i in range(50)] + [(i, i + 1) for i in range(49)]
    pairs = spark.createDataFrame(pair_list, "left_id long, right_id long")
    found = {(r[0], r[1]): r[2] for r in similarity.compare_pairs(pairs, log, "phash").collect()}
    assert found == {(a, b): bin(a ^ b).count("1") for a, b in pair_list}
    # (0, 1) is given twice and answered once; no distance here reaches the bound.
    assert similarity.near_copies(pairs, log, "phash").count() == len(set(pair_list))


# --- lookup and numbering --------------------------------------------------------------


def test_lookup_deals_out_a_hot_key_made_of_copies(spark):
    """A third of the rows are copies of one fact; no task of the join gets them all."""
    rows = [(7, 0)] * 3000 + [(i % 50, i) for i in range(6000)]
    facts = spark.createDataFrame(rows, "k long, v long").repartition(16)
    table = spark.createDataFrame([(k, k) for k in range(50)], "k long, t long")
    for conf in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.set(conf, "false" if "adaptive" in conf else "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = lookup(facts, table, "k", 200)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == len(rows) and max(sizes) < 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_is_an_inner_join_with_and_without_hot_keys(spark):
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.4 else rng.randrange(100), i) for i in range(2000)] + [(7, 5), (7, 5), (None, 1)]
    facts = spark.createDataFrame(rows, "k long, v long")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(0, 80)], "k long, t string")
    expected = sorted((k, v, f"t{k}") for k, v in rows if k is not None and k < 80)
    for hot_rows in (10, 500, 10**9):
        assert sorted(values(lookup(facts, table, "k", hot_rows), "k", "v", "t")) == expected


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_number_rows_is_the_global_row_number(spark, adaptive):
    """Without adaptive execution the small partitions stay apart, as large ones would."""
    rng = random.Random(2)
    names = sorted({f"p{rng.randrange(10**9):09d}" for _ in range(3000)})
    shuffled = names[:]
    rng.shuffle(shuffled)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.createDataFrame([(n,) for n in shuffled], "path string").repartition(7)
        numbered = number_rows(df, ["path"], 100, "id")
        assert sorted(values(numbered, "id", "path")) == [(101 + i, n) for i, n in enumerate(names)]
        assert (numbered.rdd.getNumPartitions() > 1) == (adaptive == "false")
        assert number_rows(df.limit(0), ["path"], 5, "id").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


# --- latest state ----------------------------------------------------------------------


def stat(stat_id, file_id, when, size=1, missing=False, kind="image", root="/p"):
    return Row(
        stat_id=stat_id, file_id=file_id, root_dir=root, filename=f"{file_id}.jpg", extension="jpg", size_bytes=size,
        mtime_secs=1, mtime_nanos=0, file_type=kind, is_missing=missing, observed_at=dt.datetime(2024, 1, when),
    )


def test_latest_does_not_depend_on_row_order(spark):
    rng = random.Random(3)
    rows = [stat(i, rng.randrange(20) if i % 3 else 7, rng.randrange(1, 4), i) for i in range(300)]
    expected = {}
    for r in sorted(rows, key=lambda r: (r.observed_at, r.stat_id)):
        expected[r.file_id] = r.stat_id
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows).repartition(5)
        assert dict(values(latest.latest_stat_ids(df), "file_id", "stat_id")) == expected


def test_latest_is_cut_before_the_shuffle(spark):
    plan = latest.latest_stats(spark.createDataFrame([stat(1, 1, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_duplicates_join_without_further_shuffles(spark):
    stats = spark.createDataFrame([stat(1, 1, 1)])
    hashes = spark.createDataFrame(
        [(1, 1, "blake3", "a", dt.datetime(2024, 1, 1))],
        "file_id long, stat_id long, hash_name string, hash_value string, computed_at timestamp")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reports.duplicates_report(hashes, stats, "blake3")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3 and "TakeOrderedAndProject" in plan


def test_duplicates_follow_latest_state(spark):
    stats = spark.createDataFrame(
        [stat(i, i, 1, 10 * i) for i in range(1, 7)] + [stat(10, 3, 2, 30, missing=True), stat(11, 6, 2, 0)])
    log = [(1, "a", 1), (2, "a", 1), (3, "a", 1), (4, "b", 1), (4, "c", 2), (5, "b", 1), (6, None, 1)]
    hashes = spark.createDataFrame(
        [(f, f, "blake3", h, dt.datetime(2024, 1, d)) for f, h, d in log],
        "file_id long, stat_id long, hash_name string, hash_value string, computed_at timestamp")
    rows = reports.duplicates_report(hashes, stats, "blake3").collect()
    assert [(r["hash_value"], r["file_count"], r["total_size"]) for r in rows] == [("a", 2, 30)]


def test_empty_library(spark):
    empty = spark.createDataFrame([stat(1, 1, 1)]).limit(0)
    row = reports.library_stats(latest.latest_stats(empty)).first()
    assert tuple(row) == (0, 0, 0.0, 0, 0, 0)
    listing = spark.createDataFrame([], "root_dir string, root_order int, path string, size_bytes long, mtime_secs long, mtime_nanos int")
    assert tuple(reports.scan_stats(observe.describe(listing)).first()) == (0,) * 8


def test_scan_stats_add_up(spark):
    rng = random.Random(4)
    rows = [("/p", 0, f"/p/{i}.{rng.choice(['jpg', 'mp4', 'txt', ''])}", rng.randrange(1000), 1, 0) for i in range(200)]
    listing = spark.createDataFrame(rows, "root_dir string, root_order int, path string, size_bytes long, mtime_secs long, mtime_nanos int")
    s = reports.scan_stats(observe.describe(listing)).first()
    assert s["total_files"] == s["image_count"] + s["video_count"] + s["other_count"] == 200
    assert s["total_size_bytes"] == s["image_size_bytes"] + s["video_size_bytes"] + s["other_size_bytes"] == sum(r[3] for r in rows)


def test_missing_paths_with_nested_roots(spark):
    known = spark.createDataFrame(
        [("/a", "/a/1"), ("/a", "/a/b/2"), ("/a/b", "/a/b/3"), ("/a/b", "/a/b/4"), ("/off", "/off/5")], "root_dir string, path string")
    seen = spark.createDataFrame(
        [("/a", 0, "/a/b/3"), ("/a/b", 1, "/a/b/3"), ("/a/b", 1, "/a/b/2")], "root_dir string, root_order int, path string")
    gone = values(observe.missing_paths(known, seen, ["/a", "/a/b"]), "path", "root_order")
    # /a/b/2 belonged to /a, which did not see it; the later root brings it back.
    assert sorted(gone) == [("/a/1", 0), ("/a/b/2", 0), ("/a/b/4", 1)]


# --- metadata --------------------------------------------------------------------------


def tag(**fields):
    base = dict(ifd=0, tag="T", kind="", ints=None, ratios=None, texts=None, raw=None, display="shown")
    base.update(fields)
    return tuple(base[k] for k in ("ifd", "tag", "kind", "ints", "ratios", "texts", "raw", "display"))


def ratio(num, den, kind="rational"):
    return tag(kind=kind, ratios=[(num, den)])


TAG_TEXTS = [
    (tag(kind="byte", ints=[5]), "5"), (tag(kind="short", ints=[1, 2]), "[1, 2]"), (tag(kind="long", ints=[]), "[]"),
    (ratio(50, 1), "50"), (ratio(28, 10), "2.8"), (ratio(1, 3), "0.3333333333333333"), (ratio(1, 8000), "0.000125"),
    (ratio(100, 1), "100"), (ratio(7, 0), "7/0"), (ratio(0, 5), "0"), (ratio(0, -5, "srational"), "-0"),
    (ratio(-1, 3, "srational"), "-0.3333333333333333"), (ratio(1, 4294967295), "0.00000000023283064370807974"),
    (ratio(4294967295, 1), "4294967295"), (ratio(2, 3000), "0.0006666666666666666"), (ratio(2, 1000), "0.002"),
    (tag(kind="rational", ratios=[(1, 2), (3, 4)]), "shown"), (tag(kind="rational", ratios=[]), "shown"),
    (tag(kind="ascii", texts=[b"a", b"b"]), "a, b"), (tag(kind="ascii", texts=[b"\xff", b"ok"]), "ok"),
    (tag(kind="ascii", texts=[b"\xc3\x28"]), None), (tag(kind="ascii", texts=[]), None), (tag(kind="ascii", texts=[b""]), None),
    (tag(kind="undefined", raw=b"\x00\xff"), "[0, 255]"), (tag(kind="undefined", raw=b""), "[]"),
    (tag(kind="undefined", raw=b"x" * 64), "[" + ", ".join(["120"] * 64) + "]"), (tag(kind="undefined", raw=b"x" * 65), "[65 bytes]"),
    (tag(kind="float"), "shown"),
]


def test_tag_texts(spark):
    rows = [(i, [t]) for i, (t, _) in enumerate(TAG_TEXTS)]
    df = spark.createDataFrame(rows, f"file_id int, tags array<{exif.TAG_SCHEMA}>")
    found = dict(values(metadata.exif_rows(df), "file_id", "value"))
    assert {i: found[i] for i in found if found[i] != TAG_TEXTS[i][1]} == {} and len(found) == len(TAG_TEXTS)


def test_namespaces_and_files_without_tags(spark):
    df = spark.createDataFrame(
        [(1, [tag(ifd=0), tag(ifd=1), tag(ifd=2)]), (2, []), (3, None)], f"file_id int, tags array<{exif.TAG_SCHEMA}>")
    assert sorted(values(metadata.exif_rows(df), "file_id", "namespace")) == [(1, "exif"), (1, "exif_other"), (1, "exif_thumb")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(1, 2**32 - 1)), min_size=1, max_size=30))
def test_ratios_read_back_as_the_same_number(spark, ratios):
    df = spark.createDataFrame([(n, d) for n, d in ratios], "num long, den long")
    text = exif.ratio_text(F.struct("num", "den"))
    for n, d, t in df.select("num", "den", text).collect():
        assert float(t) == n / d and "E" not in t and not (t.endswith(".0") or t.endswith("."))
        assert len(t.strip("-0.").replace(".", "")) <= len(repr(n / d).split("e")[0].strip("-0.").replace(".", ""))


PROBES = [
    ('{"format":{"tags":{"x":{"a":3.0,"b":2.50},"l":[1.0],"c":1,"c":"last"}}}',
     {("video_tag", "x", '{"a":3.0,"b":2.5}'), ("video_tag", "l", "[1.0]"), ("video_tag", "c", "last")}),
    ('{"format":{"duration":"1.5","bit_rate":"8","format_name":"mov"}}', {("video", "duration", "1.5"), ("video", "bit_rate", "8"), ("video", "format_name", "mov")}),
    ('{"format":{"duration":1.5,"bit_rate":8}}', set()),
    ('{"format":{"tags":{"a":"x","b":1,"c":2.50,"d":null,"e":true,"f":{"k":[1]},"g":1e300,"h":3.0,"i":1.5e-7}}}',
     {("video_tag", "a", "x"), ("video_tag", "b", "1"), ("video_tag", "c", "2.5"), ("video_tag", "d", "null"), ("video_tag", "e", "true"),
      ("video_tag", "f", '{"k":[1]}'), ("video_tag", "g", "1e300"), ("video_tag", "h", "3.0"), ("video_tag", "i", "1.5e-7")}),
    ('{"streams":[{"codec_type":"video","codec_name":"h264","width":10,"height":"20","r_frame_rate":"25/1","channels":2}]}',
     {("video", "stream_0_codec_type", "video"), ("video", "stream_0_codec_name", "h264"), ("video", "stream_0_width", "10"),
      ("video", "stream_0_frame_rate", "25/1")}),
    ('{"streams":[{},{"codec_type":"audio","sample_rate":"48000","channels":2,"width":1},{"codec_type":5}]}',
     {("video", "stream_0_codec_type", "unknown"), ("video", "stream_1_codec_type", "audio"), ("video", "stream_1_sample_rate", "48000"),
      ("video", "stream_1_channels", "2"), ("video", "stream_2_codec_type", "unknown")}),
    ('{"streams":{"codec_type":"video"}}', set()), ('{"streams":[{"codec_type":"video","width":10.0}]}', {("video", "stream_0_codec_type", "video")}),
    ("not json", set()), ("", set()), ("[]", set()), ('{"format":', set()), (None, set()), ("null", set()),
]


def test_probe_documents(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PROBES)], "file_id int, probe_json string")
    found = {i: set() for i in range(len(PROBES))}
    for i, *entry in values(metadata.probe_rows(df), "file_id", "namespace", "tag", "value"):
        found[i].add(tuple(entry))
    assert found == {i: e for i, (_, e) in enumerate(PROBES)}
    parts = metadata.format_rows(df).unionByName(metadata.format_tag_rows(df)).unionByName(metadata.stream_rows(df))
    assert sorted(values(parts, *parts.columns)) == sorted(values(metadata.probe_rows(df), *parts.columns))


def test_stamping_many_tags_of_one_file(spark):
    stats = spark.createDataFrame([stat(1, 1, 1), stat(2, 1, 2), stat(3, 2, 1)])
    rows = spark.createDataFrame(
        [(1, "exif", f"t{i}", "v") for i in range(100)] + [(2, "exif", "t", None), (9, "exif", "t", "v")],
        "file_id long, namespace string, tag string, value string")
    for row_per_file in (True, False):
        stamped = metadata.stamp(rows, stats, row_per_file)
        assert sorted(set(values(stamped, "file_id", "stat_id"))) == [(1, 2), (2, 3)] and stamped.count() == 101


# --- streams ---------------------------------------------------------------------------


def test_latest_state_stream_over_several_runs(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("log", "latest", "progress"))
    days = [[stat(i, i % 7, day, i) for i in range(day * 20, day * 20 + 20)] for day in range(1, 4)]
    for rows in days:
        spark.createDataFrame(rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        latest_state.maintain_latest(stream, target, progress).awaitTermination()
        maintained = latest_state.read_latest(spark, target)
        assert sorted(values(maintained, "file_id", "stat_id")) == sorted(
            values(latest.latest_stats(spark.read.parquet(source)), "file_id", "stat_id"))


def test_first_hash_stream_over_several_runs(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("log", "first", "progress"))
    schema = "file_id long, stat_id long, hash_name string, hash_value string, computed_at timestamp"
    for run in range(3):
        rows = [(1 if i % 2 else i % 9, run * 100 + i, "blake3", "x", dt.datetime(2024, 1, 1 + run)) for i in range(100)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        first_hash.maintain_first(stream, target, progress).awaitTermination()
    found = values(first_hash.read_first(spark, target), "file_id", "stat_id")
    assert sorted(f for f, _ in found) == list(range(9)) and all(s < 20 for _, s in found)


@pytest.mark.parametrize("name", ["stream_latest_state", "stream_first_hash"])
def test_streams_over_a_folder_of_files(spark, tmp_path, name):
    from photarium.registry.queries import QUERIES

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.repartition(5).write.parquet(str(tmp_path / "orders.parquet"))
    assert sorted(map(str, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(
        map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
