"""Bitmaps of hashed files against the work-lists from the log."""

import random

import pytest
from pyspark.sql import functions as F

from photarium.operators import hash_index, worklist

FILES = "id long, path string, size_bytes long, mtime_secs long, file_type string, is_missing boolean"
HASHES = "file_id long, hash_name string, hash_value string"
NAMES = ["blake3", "phash", "dhash"]


def rows_of(df):
    return sorted(df.collect())


@pytest.fixture(scope="module")
def library(spark):
    draw = random.Random(3)
    # Both ends of blocks and bytes, a negative id, and ids many blocks apart.
    ids = [-5, 0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, 65537, 10**9, *range(100, 400)]
    files = [(i, f"/p/{i}", abs(i), 5, draw.choice(["image", "video", "other"]), draw.random() < 0.2) for i in ids]
    log = [(draw.choice(ids), draw.choice(NAMES), draw.choice([None, "x"])) for _ in range(500)]
    # One file with very many rows; files that are not catalogued; rows that say nothing.
    log += [(7, "blake3", "x")] * 3000 + [(77_777, "phash", "x"), (None, "phash", "x"), (1, None, "x")]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(log, HASHES).repartition(3)


@pytest.mark.parametrize("name", [*NAMES, "whash"])
@pytest.mark.parametrize("file_type", [None, "image"])
def test_work_lists_from_bitmaps(library, name, file_type):
    files, log = library
    found = hash_index.needing_hash(files, hash_index.build(log), name, file_type)
    assert rows_of(found) == rows_of(worklist.needing_hash(files, log, name, file_type))


def test_coverage_from_bitmaps(library):
    files, log = library
    index = hash_index.build(log)
    assert rows_of(hash_index.hash_coverage(files, index)) == rows_of(worklist.hash_coverage(files, log))
    for part, logged in ((files.limit(0), log), (files, log.limit(0))):
        found = hash_index.hash_coverage(part, hash_index.build(logged))
        assert rows_of(found) == rows_of(worklist.hash_coverage(part, logged))


def test_an_index_is_kept_up_to_date_by_merging(library):
    _, log = library
    parts = log.randomSplit([0.3, 0.3, 0.4], 1)
    merged = hash_index.merge(*[hash_index.build(p) for p in parts])
    whole = hash_index.build(log)
    assert rows_of(merged.select("hash_name", "block", F.hex("files"))) == rows_of(whole.select("hash_name", "block", F.hex("files")))


def test_every_bit_of_a_block(spark):
    log = spark.range(-40_000, 40_000).select(F.col("id").alias("file_id"), F.lit("blake3").alias("hash_name"), F.lit("x").alias("hash_value"))
    odd = hash_index.build(log.filter(F.pmod("file_id", F.lit(2)) == 1))
    files = log.select(
        F.col("file_id").alias("id"), F.lit("p").alias("path"), F.lit(0).alias("size_bytes"), F.lit(0).alias("mtime_secs"),
        F.lit("other").alias("file_type"), F.lit(False).alias("is_missing"))
    left = hash_index.needing_hash(files, odd, "blake3")
    assert left.count() == 40_000 and left.filter(F.pmod("id", F.lit(2)) == 1).isEmpty()


def test_the_log_is_not_read(spark, library, tmp_path):
    files, log = library
    for rows, name in ((files, "files"), (log, "log"), (hash_index.build(log), "index")):
        rows.write.parquet(str(tmp_path / name))
    stored = {n: spark.read.parquet(str(tmp_path / n)) for n in ("files", "index")}
    for df in (hash_index.needing_hash(stored["files"], stored["index"], "blake3"), hash_index.hash_coverage(**stored)):
        assert not any("/log/" in name for name in df.inputFiles())
