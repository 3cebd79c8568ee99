"""The inventory data source against a plain walk."""

import os

import pytest

from photarium.sources import inventory


def plainly(*roots):
    rows = set()
    for order, root in enumerate(roots):
        for folder, _, names in os.walk(root):
            for name in names:
                path = os.path.join(folder, name)
                if not os.path.islink(path):
                    info = os.stat(path)
                    rows.add((str(root), order, path, info.st_size, info.st_mtime_ns // 10**9, info.st_mtime_ns % 10**9))
    return rows


def listed(spark, *roots, **options):
    rows = [tuple(r) for r in inventory.walk(spark, [str(r) for r in roots], **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def tree(root, folders, files=3):
    for i in range(folders):
        place = root / f"d{i % 7}" / f"e{i % 5}" / f"f{i}"
        place.mkdir(parents=True)
        for k in range(files):
            (place / f"{'.' if k == 1 else ''}file{k}").write_bytes(b"x" * (i + k))


@pytest.mark.parametrize("shares", [1, 4, 100])
def test_trees_with_hidden_files_and_links(spark, tmp_path, shares):
    one, two = tmp_path / "one", tmp_path / "two"
    tree(one, 40)
    tree(two, 5)
    (one / "top").write_text("t")
    (one / ".hidden").mkdir()
    (one / ".hidden" / "_x").write_text("h")
    (one / "link").symlink_to(one / "top")
    (one / "loop").symlink_to(one)
    (two / "empty").mkdir()
    os.utime(one / "top", ns=(1, 1_700_000_000_123_456_789))
    assert listed(spark, one, two, one / ".hidden", shares=shares) == plainly(one, two, one / ".hidden")
    assert ("top", 123_456_789) in {(os.path.basename(r[2]), r[5]) for r in listed(spark, one)}


def test_no_roots_empty_root_and_a_file_as_root(spark, tmp_path):
    assert listed(spark) == set() and listed(spark, tmp_path) == set()
    (tmp_path / "one").write_text("1")
    assert [r[2] for r in listed(spark, tmp_path / "one")] == [str(tmp_path / "one")]
    assert inventory.reachable_roots(spark, [str(tmp_path), str(tmp_path / "absent")]) == [str(tmp_path)]


def test_flat_folder_of_100_000_files_is_shared(spark, tmp_path):
    for i in range(100_000):
        open(tmp_path / f"f{i}", "w").close()
    shares = inventory.InventoryReader([str(tmp_path)], 4).partitions()
    assert [(s.part, s.parts, s.whole) for s in shares] == [(0, 2, False), (1, 2, False)]
    assert len(listed(spark, tmp_path)) == 100_000


def test_tree_200_deep(spark, tmp_path):
    place = tmp_path
    for i in range(200):
        place = place / "d"
    place.mkdir(parents=True)
    for folder, _, _ in list(os.walk(tmp_path)):
        open(os.path.join(folder, "f"), "w").close()
    assert len(listed(spark, tmp_path)) == 201 and listed(spark, tmp_path) == plainly(tmp_path)


def test_unreadable_folder_and_odd_names(spark, tmp_path, monkeypatch):
    tree(tmp_path, 6)
    odd = os.fsencode(tmp_path) + b"/\xff\xfe"
    open(odd, "w").close()
    real = os.scandir

    def refusing(folder):
        if os.fsdecode(folder).endswith("f3"):
            raise PermissionError(13, "refused")
        return real(folder)

    monkeypatch.setattr(inventory.os, "scandir", refusing)
    reader = inventory.InventoryReader([str(tmp_path)], 3)
    found = [p for s in reader.partitions() for b in reader.read(s) for p in b.column("path").to_pylist()]
    assert len(found) == 5 * 3 + 1 and not any("/f3/" in p for p in found)
    assert sum(p.endswith("��") for p in found) == 1


def test_one_job(spark, tmp_path):
    tree(tmp_path, 30)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("inventory", "listing")
    try:
        assert len(inventory.walk(spark, [str(tmp_path)], shares=8).collect()) == 90
        assert len(tracker.getJobIdsForGroup("inventory")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
