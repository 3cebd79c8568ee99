"""The catalog on storage: lifecycles of files, hashes, tags and runs."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from photarium.catalog import Catalog
from photarium.functions.errors import NotCatalogued, UnknownAlgorithm
from photarium.operators.algorithms import ALGORITHMS, Algorithm, register
from photarium.settings import ScanSettings
from photarium.sources import inventory, media


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


def write_png(path, pixels, comment=None):
    """8-bit gray PNG, optionally with a text chunk that changes the file but not the pixels."""

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    rows = b"".join(b"\0" + bytes(row) for row in pixels)
    text = chunk(b"tEXt", b"Comment\0" + comment.encode()) if comment else b""
    header = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + text + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    )


def test_tables_are_created_once(spark, tmp_path):
    first = Catalog(spark, str(tmp_path / "c"))
    first.upsert_file("/p/a.jpg", "/p", 1)
    again = Catalog(spark, str(tmp_path / "c"))
    assert again.master.count() == 1
    assert again.hashes.count() == again.metadata.count() == again.table("run_events").count() == 0


def test_observing_twice_keeps_the_id_and_both_rows(catalog):
    first = catalog.upsert_file("/p/a.JPG", "/p", 1024, 1000)
    second = catalog.upsert_file("/p/a.JPG", "/p", 2048, 1001)
    assert first == second
    assert catalog.stats.count() == 2
    row = catalog.files().first()
    assert (row["size_bytes"], row["mtime_secs"], row["extension"], row["file_type"]) == (2048, 1001, "jpg", "image")
    assert [r["size_bytes"] for r in catalog.history(first).collect()] == [1024, 2048]


def test_missing_is_set_carried_and_cleared(catalog):
    catalog.upsert_file("/p/a.jpg", "/p", 10, 5, 7)
    catalog.mark_missing("/p/a.jpg", "/p/never-seen.jpg")
    row = catalog.files().first()
    assert row["is_missing"] and (row["size_bytes"], row["mtime_secs"], row["mtime_nanos"]) == (10, 5, 7)
    assert catalog.file_exists("/p/a.jpg") and not catalog.file_exists("/p/never-seen.jpg")
    assert catalog.active_files("/p").count() == catalog.known_paths("/p").count() == 0
    catalog.upsert_file("/p/a.jpg", "/p", 10)
    assert not catalog.files().first()["is_missing"]
    assert catalog.stats.count() == 3


def test_roots_compare_as_text(catalog):
    catalog.upsert_file("/p/a.jpg", "/p", 10)
    assert catalog.active_files("/p").count() == 1
    assert catalog.active_files("/p/").count() == 0


def test_hashes_latest_wins_and_names_are_checked(catalog):
    file_id = catalog.upsert_file("/p/a.jpg", "/p", 10)
    catalog.set_hash(file_id, "blake3", "aa")
    catalog.set_hash(file_id, "blake3", "bb")
    catalog.set_perceptual_hash(file_id, "phash", -12345678)
    values = {r["hash_name"]: r["hash_value"] for r in catalog.latest_hashes().collect()}
    assert values == {"blake3": "bb", "phash": "-12345678"}
    assert catalog.hashes.count() == 3
    with pytest.raises(UnknownAlgorithm, match="HASH_UNKNOWN_ALGORITHM. algorithm: sha256"):
        catalog.set_hash(file_id, "sha256", "cc")
    with pytest.raises(NotCatalogued, match="DB_SET_HASH_FAILED. file_id: 99"):
        catalog.set_hash(99, "blake3", "cc")
    with pytest.raises(NotCatalogued, match="DB_INSERT_METADATA_FAILED. file_id: 99"):
        catalog.insert_metadata(99, [("exif", "Make", "A")])


def test_one_hash_name_reads_one_partition(catalog):
    catalog.set_hash(catalog.upsert_file("/p/a.jpg", "/p", 10), "phash", "12")
    plan = catalog.latest_hashes("blake3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hash_name" in plan
    plan = catalog.library_stats()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<stat_id:bigint,file_id:bigint,size_bytes:bigint,file_type:string,is_missing:boolean" in plan


def test_failed_results_are_returned_and_not_stored(spark, catalog):
    file_id = catalog.upsert_file("/p/a.jpg", "/p", 10)
    results = spark.createDataFrame(
        [(file_id, "blake3", "aa"), (file_id, "sha256", "bb"), (99, "blake3", "cc")],
        "file_id long, hash_name string, hash_value string")
    failures = catalog.record_hashes(results).collect()
    assert sorted(f["error_message"] for f in failures) == [
        "DB_SET_HASH_FAILED. file_id: 99 (never observed)", "HASH_UNKNOWN_ALGORITHM. algorithm: sha256"]
    assert [r["hash_value"] for r in catalog.hashes.collect()] == ["aa"]


def test_metadata_latest_value_wins(catalog):
    file_id = catalog.upsert_file("/p/a.jpg", "/p", 10)
    catalog.insert_metadata(file_id, [("exif", "Make", "A"), ("exif", "ISO", "100"), ("exif", "Note", None)])
    catalog.insert_metadata(file_id, [("exif", "Make", "B")])
    catalog.insert_metadata(file_id, [])
    values = {r["tag"]: r["value"] for r in catalog.latest_metadata().collect()}
    assert values == {"Make": "B", "ISO": "100", "Note": None}
    assert catalog.metadata.count() == 4


def test_hash_work_list(catalog):
    sizes = {"/p/big.jpg": 9999, "/p/small.jpg": 10, "/p/mid.mp4": 500, "/p/gone.jpg": 1, "/p/done.jpg": 2}
    ids = {path: catalog.upsert_file(path, "/p", size) for path, size in sizes.items()}
    catalog.mark_missing("/p/gone.jpg")
    catalog.set_hash(ids["/p/done.jpg"], "blake3", "aa")
    assert [r["size_bytes"] for r in catalog.files_needing_hash("blake3").collect()] == [10, 500, 9999]
    assert [r["size_bytes"] for r in catalog.files_needing_hash("phash", "image").collect()] == [2, 10, 9999]
    with pytest.raises(UnknownAlgorithm):
        catalog.files_needing_hash("md5")
    # Changed after hashing: only the version-aware list names it.
    catalog.upsert_file("/p/done.jpg", "/p", 3)
    assert catalog.files_needing_hash("blake3").count() == 3
    assert [r["size_bytes"] for r in catalog.files_needing_hash("blake3", refresh_stale=True).collect()] == [3, 10, 500, 9999]
    # Observed again unchanged: a hash stays fresh.
    catalog.set_hash(ids["/p/done.jpg"], "blake3", "bb")
    catalog.upsert_file("/p/done.jpg", "/p", 3)
    assert catalog.files_needing_hash("blake3", refresh_stale=True).count() == 3


def test_metadata_work_list(catalog):
    for name in ("a.jpg", "b.mp4", "c.txt", "d.png"):
        file_id = catalog.upsert_file(f"/p/{name}", "/p", 1)
    catalog.insert_metadata(file_id, [("exif", "Make", "A")])
    assert sorted(r["path"] for r in catalog.files_needing_metadata().collect()) == ["/p/a.jpg", "/p/b.mp4"]


def test_run_log(catalog):
    first = catalog.create_run(1)
    second = catalog.create_run(3, "blake3", "/p")
    assert second == first + 1
    catalog.update_run(second, 50, 100)
    status = {r["id"]: r for r in catalog.runs().collect()}
    assert status[second]["status"] == "running" and status[second]["files_processed"] == 50
    assert status[first]["files_processed"] == 0 and status[first]["completed_at"] is None
    catalog.complete_run(second, "completed")
    row = {r["id"]: r for r in catalog.runs().collect()}[second]
    assert (row["status"], row["scan_level"], row["hash_type"], row["root_dir"]) == ("completed", 3, "blake3", "/p")
    assert row["completed_at"] is not None and row["files_total"] == 100
    assert [r["percent"] for r in catalog.run_progress().collect()] == [50]


def test_events_of_unknown_runs_change_nothing(catalog):
    catalog.update_run(77, 5, 10)
    catalog.complete_run(78, "completed")
    assert catalog.runs().count() == catalog.run_progress().count() == 0
    known = catalog.create_run(1)
    catalog.complete_run(known + 1, "failed")
    assert [(r["id"], r["status"]) for r in catalog.runs().collect()] == [(known, "running")]


GRADIENT = [[(x * 9 + y * 3) % 256 for x in range(24)] for y in range(16)]


def test_images_are_opened_by_their_catalogued_path(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    (one / "_edited").mkdir(parents=True)
    two.mkdir()
    for path in (one / "a.png", one / "_DSC0001.png", one / ".b.png", one / "_edited" / "c.png", two / "gone.png"):
        write_png(path, GRADIENT)
    os.utime(one / "a.png", (1_000_000, 1_000_000))
    catalog = Catalog(spark, str(tmp_path / "catalog"), ScanSettings().with_roots(str(one), str(two)))
    catalog.scan()
    write_png(one / "a.png", GRADIENT, "replaced")
    os.utime(one / "a.png", (500_000, 500_000))  # an older date than at the scan
    catalog.settings = ScanSettings().with_roots(str(one))  # the second root is no longer set
    assert catalog.scan_hashes("content_blake3").count() == 0
    assert catalog.scan_hashes("phash").count() == 0
    for name in ("content_blake3", "phash"):
        found = catalog.latest_hashes(name).collect()
        assert len(found) == 5 and len({r["hash_value"] for r in found}) == 1


def test_what_cannot_be_decoded_is_not_tried_again(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "old.heic").write_bytes(b"no such format")
    write_png(root / "a.png", GRADIENT)
    catalog = Catalog(spark, str(tmp_path / "catalog"), ScanSettings().with_roots(str(root)))
    catalog.scan()
    assert [f["error_code"] for f in catalog.scan_hashes("phash").collect()] == ["HASH_DECODE_FAILED"]
    assert catalog.scan_hashes("phash").count() == 0
    assert catalog.scan_hashes("phash", retry=True).count() == 1
    assert catalog.scan_hashes("dhash").count() == 1
    write_png(root / "old.heic", GRADIENT)
    catalog.scan()
    assert catalog.scan_hashes("phash").count() == 0
    assert catalog.latest_hashes("phash").count() == 2


def test_registered_byte_algorithms_hash_files(spark, tmp_path):
    class Crc:
        """CRC-32 in chunks, with the interface of hashlib."""

        def __init__(self):
            self.value = 0

        def update(self, data):
            self.value = zlib.crc32(data, self.value)

        def hexdigest(self):
            return str(self.value)

    root = tmp_path / "root"
    root.mkdir()
    (root / "a.txt").write_bytes(b"hello")
    catalog = Catalog(spark, str(tmp_path / "catalog"), ScanSettings().with_roots(str(root)))
    catalog.scan()
    try:
        register(Algorithm("crc", "bytes", lambda c: F.crc32(c).cast("string"), hasher=Crc))
        register(Algorithm("crc_column", "bytes", lambda c: F.crc32(c).cast("string")))
        assert catalog.scan_hashes("crc").count() == 0
        assert [r["hash_value"] for r in catalog.latest_hashes("crc").collect()] == ["907060870"]
        with pytest.raises(ValueError):
            catalog.scan_hashes("crc_column")
    finally:
        ALGORITHMS.pop("crc")
        ALGORITHMS.pop("crc_column")


def test_scans_leave_no_copies_behind(spark, tmp_path):
    from photarium.session import shared_dir

    root = tmp_path / "root"
    root.mkdir()
    write_png(root / "a.png", GRADIENT)
    catalog = Catalog(spark, str(tmp_path / "catalog"), ScanSettings().with_roots(str(root)))
    before = set(os.listdir(shared_dir(spark)))
    catalog.scan()
    catalog.scan_hashes("phash").collect()
    left = {name.split("-")[0] for name in set(os.listdir(shared_dir(spark))) - before}
    assert left <= {"hashed"}


def test_no_pixels_above_a_shuffle(spark, tmp_path):
    write_png(tmp_path / "1", GRADIENT)
    work = spark.createDataFrame([(1, str(tmp_path / "1"), 10)], "id long, path string, size_bytes long")
    found = media.image_hashes(work, str(tmp_path / "staged"), media.pixel_digest()("image"), lambda digest: digest)
    assert found.first()["error_code"] is None
    above = found._jdf.queryExecution().executedPlan().toString().split("regexp_extract(image")[0]
    assert "image#" not in above


def test_scan_hash_and_report_on_real_files(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    (one / "nested" / ".hidden").mkdir(parents=True)
    two.mkdir()
    gradient = [[(x * 9 + y * 3) % 256 for x in range(24)] for y in range(16)]
    bigger = [[gradient[y // 2][x // 2] for x in range(48)] for y in range(32)]
    inverted = [[255 - v for v in row] for row in gradient]
    write_png(one / "a.png", gradient)
    write_png(one / "nested" / "copy of a+b%20.png", gradient)
    write_png(two / "tagged.png", gradient, "same pixels")
    write_png(two / "big.png", bigger)
    write_png(two / "inverted.png", inverted)
    (two / "broken.jpg").write_bytes(b"not a picture")
    (one / "nested" / ".hidden" / ".note").write_text("x")
    os.symlink(one / "a.png", two / "link.png")
    settings = ScanSettings().with_roots(str(one), str(two), str(tmp_path / "absent"))
    catalog = Catalog(spark, str(tmp_path / "catalog"), settings)

    totals = catalog.scan().first()
    assert (totals["total_files"], totals["image_count"], totals["other_count"]) == (7, 6, 1)
    assert totals["total_size_bytes"] == sum(
        os.path.getsize(os.path.join(d, f)) for r in (one, two) for d, _, fs in os.walk(r) for f in fs
        if not os.path.islink(os.path.join(d, f))
    )
    stored = catalog.files().filter("filename = 'a.png'").first()
    info = os.stat(one / "a.png")
    assert stored["mtime_secs"] * 10**9 + stored["mtime_nanos"] == info.st_mtime_ns

    assert catalog.scan_hashes("blake3").count() == 0
    assert catalog.files_needing_hash("blake3").count() == 0
    groups = catalog.duplicates("blake3").collect()
    assert [(g["file_count"], len(g["digest_prefix"])) for g in groups] == [(2, 16)]

    failures = catalog.scan_hashes("content_blake3").collect()
    assert [f["error_code"] for f in failures] == ["HASH_DECODE_FAILED"]
    assert "broken.jpg" in failures[0]["error_message"]
    assert [g["file_count"] for g in catalog.duplicates("content_blake3").collect()] == [3]

    for name in ("phash", "dhash", "whash"):
        assert catalog.scan_hashes(name).count() == 1
        assert catalog.latest_hashes(name).count() == 5
    paths = {r["id"]: os.path.basename(r["path"]) for r in catalog.files().collect()}
    prints = {paths[r["file_id"]]: int(r["hash_value"]) for r in catalog.latest_hashes("phash").collect()}
    distance = lambda a, b: bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1")
    assert distance("a.png", "tagged.png") == 0
    assert distance("a.png", "big.png") <= 10
    assert distance("a.png", "inverted.png") > 30
    with pytest.raises(UnknownAlgorithm):
        catalog.duplicates("phash")

    (two / "big.png").unlink()
    (one / "a.png").write_bytes(b"changed")
    states = {os.path.basename(r["path"]): r["state"] for r in catalog.changes().collect()}
    assert (states["big.png"], states["a.png"], states["tagged.png"]) == ("missing", "modified", "unchanged")
    catalog.scan()
    stats = catalog.library_stats().first()
    assert (stats["total_files"], stats["image_count"], stats["video_count"], stats["other_count"]) == (6, 5, 0, 1)
    assert [r["state"] for r in catalog.changes().filter("path like '%big.png'").collect()] == ["still_missing"]


def test_listing_through_the_file_index(spark, tmp_path):
    root = tmp_path / "objects"
    (root / "sub dir").mkdir(parents=True)
    (root / "a+b.jpg").write_bytes(b"123")
    (root / "sub dir" / "c%20d.txt").write_bytes(b"4567")
    (root / ".hidden").write_bytes(b"8")
    expected = {str(root / "a+b.jpg"): 3, str(root / "sub dir" / "c%20d.txt"): 4}
    listing = inventory.list_objects(spark, [str(root)])
    assert {r["path"]: r["size_bytes"] for r in listing.collect()} == expected
    walked = inventory.walk(spark, [str(root)])
    assert {r["path"]: r["size_bytes"] for r in walked.collect()} == {**expected, str(root / ".hidden"): 1}
    assert {r["path"]: r["mtime_secs"] for r in listing.collect()} == {
        r["path"]: r["mtime_secs"] for r in walked.collect() if r["path"] in expected}
    assert inventory.walk(spark, []).count() == inventory.list_objects(spark, []).count() == 0


def test_no_reachable_root(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"), ScanSettings(roots=(str(tmp_path / "absent"),)))
    catalog.upsert_file("/p/a.jpg", "/p", 10)
    assert catalog.scan().first()["total_files"] == 0
    assert not catalog.files().first()["is_missing"]


def test_unreadable_file_is_reported(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.jpg").write_bytes(b"1"), (root / "b.jpg").write_bytes(b"2")
    catalog = Catalog(spark, str(tmp_path / "catalog"), ScanSettings(roots=(str(root),)))
    catalog.scan()
    (root / "a.jpg").unlink()
    failures = catalog.scan_hashes("blake3").collect()
    assert [f["error_code"] for f in failures] == ["IO_ERROR"] and "a.jpg" in failures[0]["error_message"]
    assert [r["path"] for r in catalog.files_needing_hash("blake3").collect()] == [str(root / "a.jpg")]


def test_absent_root_keeps_its_files_and_an_empty_one_loses_them(spark, tmp_path):
    kept, emptied = tmp_path / "kept", tmp_path / "emptied"
    kept.mkdir(), emptied.mkdir()
    (kept / "a.jpg").write_bytes(b"1"), (emptied / "b.jpg").write_bytes(b"22")
    settings = ScanSettings().with_roots(str(kept), str(emptied))
    catalog = Catalog(spark, str(tmp_path / "catalog"), settings)
    catalog.scan()
    (kept / "a.jpg").rename(tmp_path / "a.jpg")
    kept.rmdir()
    (emptied / "b.jpg").unlink()
    catalog.scan()
    missing = {os.path.basename(r["path"]): r["is_missing"] for r in catalog.files().collect()}
    assert missing == {"a.jpg": False, "b.jpg": True}


def test_nested_roots_count_twice_and_the_last_root_owns_the_file(spark, tmp_path):
    inner = tmp_path / "lib" / "inner"
    inner.mkdir(parents=True)
    (inner / "a.jpg").write_bytes(b"123")
    settings = ScanSettings().with_roots(str(tmp_path / "lib"), str(inner))
    catalog = Catalog(spark, str(tmp_path / "catalog"), settings)
    for _ in range(2):
        assert catalog.scan().first()["total_files"] == 2
        row = catalog.files().collect()
        assert len(row) == 1 and row[0]["root_dir"] == str(inner) and not row[0]["is_missing"]
    assert catalog.stats.count() == 4


def test_metadata_scan_by_path(spark, catalog):
    for name in ("a.jpg", "b.mp4", "c.txt"):
        catalog.upsert_file(f"/p/{name}", "/p", 1)
    tag = (0, "ISO", "short", [200], None, None, None, None)
    from photarium.functions.exif import TAG_SCHEMA

    tags = spark.createDataFrame(
        [("/p/a.jpg", [tag]), ("/p/b.mp4", [tag]), ("/p/c.txt", [tag])], f"path string, tags array<{TAG_SCHEMA}>"
    )
    probes = spark.createDataFrame(
        [("/p/b.mp4", '{"format":{"duration":"1.5"}}'), ("/p/a.jpg", '{"format":{"duration":"9"}}')],
        "path string, probe_json string",
    )
    catalog.scan_metadata(tags, probes)
    rows = sorted((r["namespace"], r["tag"], r["value"]) for r in catalog.metadata.collect())
    assert rows == [("exif", "ISO", "200"), ("video", "duration", "1.5")]
    catalog.scan_metadata(tags, probes)
    assert catalog.metadata.count() == 2
