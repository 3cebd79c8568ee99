"""Versions of files against a plain loop, however a file's rows are cut."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from photarium.operators.versions import file_versions

STATS = "file_id long, stat_id long, root_dir string, size_bytes long, mtime_secs long, mtime_nanos int, is_missing boolean, observed_at timestamp_ntz"


def plainly(rows, state):
    out, last = [], {}
    at = {name: i for i, name in enumerate("file_id stat_id root_dir size_bytes mtime_secs mtime_nanos is_missing observed_at".split())}
    for row in sorted(rows, key=lambda r: (r[0], r[7], r[1])):
        own = tuple(row[at[c]] for c in state)
        before = last.get(row[0])
        if before and before["state"] == own:
            before["last"], before["n"] = row[7], before["n"] + 1
            continue
        last[row[0]] = new = {
            "id": row[0], "version": before["version"] + 1 if before else 1, "state": own, "first": row[7], "last": row[7], "n": 1,
            "stat": row[1], "size": row[3], "delta": row[3] - before["size"] if before else None,
        }
        out.append(new)
    return {(v["id"], v["version"], *v["state"], v["first"], v["last"], v["n"], v["stat"], v["delta"]) for v in out}


def history(seed, files=6, n=300):
    rng = random.Random(seed)
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(n):
        file_id = 0 if rng.random() < 0.6 else rng.randrange(files)
        calm = i % 100 < 60 and file_id == 0
        rows.append((
            file_id, i, rng.choice(["/a", None]) if not calm else "/a", 5 if calm else rng.randrange(2), 1, rng.choice([0, None]) if not calm else 0,
            rng.random() < 0.2 and not calm, start + dt.timedelta(hours=rng.randrange(n) if i % 3 else i),
        ))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot_rows", [3, 20, 1_000_000])
def test_equals_a_loop(spark, seed, hot_rows):
    rows = history(seed)
    state = ["root_dir", "mtime_nanos", "is_missing"]
    got = file_versions(spark.createDataFrame(rows, STATS), state, hot_rows)
    assert {tuple(r) for r in got.collect()} == plainly(rows, state)


def test_a_calm_file_is_one_version_over_many_pieces(spark):
    rows = spark.range(5_000).selectExpr(
        "7L AS file_id", "id AS stat_id", "'/a' AS root_dir", "1L AS size_bytes", "2L AS mtime_secs", "3 AS mtime_nanos", "false AS is_missing",
        "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, id) AS observed_at")
    assert [(r["version"], r["observations"], r["first_stat_id"]) for r in file_versions(rows, hot_rows=100).collect()] == [(1, 5_000, 0)]


def test_a_hot_file_is_cut(spark):
    """The windows run over pieces, none of which holds much more than its share."""
    from photarium.operators.versions import _pieces

    rows = spark.range(10_000).select(F.lit(1).alias("file_id"), (F.timestamp_seconds(F.col("id") * 60)).cast("timestamp_ntz").alias("observed_at"))
    sizes = [r["count"] for r in _pieces(rows, 1_000).groupBy("piece").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 1_001


def test_one_time_for_all_rows_and_none(spark):
    rows = [(1, i, "/a", i % 2, 1, 0, False, dt.datetime(2024, 1, 1)) for i in range(20)]
    assert {tuple(r) for r in file_versions(spark.createDataFrame(rows, STATS), ["size_bytes"], 4).collect()} == plainly(rows, ["size_bytes"])
    assert file_versions(spark.createDataFrame([], STATS)).count() == 0
