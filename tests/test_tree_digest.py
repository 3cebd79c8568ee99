"""Tree digests of columns and files: same classes as whole digests, ranges read apart."""

import hashlib
import os
import random

import pytest

from photarium.operators import fingerprints
from photarium.sources import media


def plainly(data, leaf, fan):
    level = [hashlib.sha256(data[i:i + leaf]).hexdigest() for i in range(0, max(len(data), 1), leaf)]
    while len(level) > 1:
        parts = [level[i:i + fan] for i in range(0, len(level), fan)]
        level = [p[0] if len(p) == 1 else hashlib.sha256("".join(p).encode()).hexdigest() for p in parts]
    return hashlib.sha256(f"{len(data)}:{leaf}:{fan}:{level[0]}".encode()).hexdigest()


def contents():
    rng = random.Random(2)
    base = bytes(rng.randrange(256) for _ in range(1_000))
    found = [base[:n] for n in (0, 1, 9, 10, 11, 99, 100, 101, 1_000)] + [base[:100], base[:99] + b"x", b"y" + base[1:100], base + b"\0", b"a" * 10, b"a" * 20]
    # The digests of two leaves one after the other are no content with the same tree.
    return [*found, "".join(hashlib.sha256(base[i:i + 10]).hexdigest() for i in (0, 10)).encode(), base[:20]]


@pytest.mark.parametrize("leaf, fan", [(10, 2), (7, 3), (10_000, 1_024)])
def test_columns(spark, leaf, fan):
    rows = [*enumerate(contents()), (100, None)]
    got = {r["file_id"]: r["digest"] for r in fingerprints.tree_digest(
        spark.createDataFrame(rows, "file_id long, content binary"), "file_id", "content", leaf, fan).collect()}
    assert got == {i: None if data is None else plainly(data, leaf, fan) for i, data in rows}


def test_classes_of_full_digests(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    trees = fingerprints.tree_digest(docs, "doc_id", "text", 64, 4)
    both = docs.selectExpr("doc_id", "sha2(text, 256) AS whole").join(trees, "doc_id").collect()
    assert len(both) == docs.count()
    assert len({r["whole"] for r in both}) == len({r["digest"] for r in both}) == len({(r["whole"], r["digest"]) for r in both}) < len(both)


def test_files_are_read_in_ranges(spark, tmp_path):
    work = []
    for i, data in enumerate(contents()):
        (tmp_path / f"f{i}").write_bytes(data)
        work.append((i, str(tmp_path / f"f{i}"), len(data)))
    work += [(50, str(tmp_path / "absent"), 30), (51, work[3][1], 25), (52, "file://" + work[8][1], 1_000)]
    rows = media.tree_digest_files(spark.createDataFrame(work, "id long, path string, size_bytes long"), 10).collect()
    got = {r["id"]: r for r in rows}
    assert len(rows) == len(work)
    for i, data in enumerate(contents()):
        assert got[i]["digest"] == plainly(data, 10, fingerprints.FAN) and got[i]["error_code"] is None
    assert got[52]["digest"] == got[8]["digest"]
    assert got[50]["error_code"] == got[51]["error_code"] == "IO_ERROR" or got[50]["error_code"] == got[51]["error_code"]
    assert got[50]["digest"] is None and "shorter than listed" in got[51]["error_message"]


def test_a_large_file_is_many_tasks_work(spark, tmp_path):
    path = tmp_path / "large"
    with open(path, "wb") as file:
        file.truncate(64 * 1024 ** 2)
    work = spark.createDataFrame([(1, str(path), os.path.getsize(path))], "id long, path string, size_bytes long")
    from pyspark.sql import functions as F

    listed = media.leaves(work, F.col("size_bytes"), 1024 ** 2)
    assert listed.count() == 64
    assert media.tree_digest_files(work, 1024 ** 2).first()["digest"] == plainly(bytes(64 * 1024 ** 2), 1024 ** 2, fingerprints.FAN)
