"""Clusters, fingerprint search and members of duplicate groups."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from photarium.functions.errors import UnknownAlgorithm
from photarium.operators import reports, similarity
from photarium.operators.components import components

LINKS = "left_id long, right_id long"


def plainly(pairs):
    """Smallest id of each id's component, by union and find."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in list(root)}


def found(spark, pairs, **options):
    return {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, LINKS), **options).collect()}


def test_chain_of_200(spark):
    names = random.Random(4).sample(range(10_000), 200)
    pairs = list(zip(names, names[1:]))
    assert found(spark, pairs) == plainly(pairs) and set(found(spark, pairs).values()) == {min(names)}


def test_star_of_100_000_with_its_hub_last(spark):
    """The hub is the largest id, so its links are a hot key; they are dealt out."""
    links = spark.range(100_000).select(F.col("id").alias("left_id"), F.lit(10**9).alias("right_id"))
    rows = components(links, hot_rows=5_000)
    assert rows.count() == 100_001 and rows.filter("root <> 0").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
    assert found(spark, pairs, hot_rows=3) == plainly(pairs)


def test_loops_repeats_nulls_and_nothing(spark):
    pairs = [(5, 5), (1, 2), (2, 1), (1, 2), (None, 3), (4, None), (9, 8), (8, 7), (-1, 9)]
    assert found(spark, pairs) == {5: 5, 1: 1, 2: 1, 9: -1, 8: -1, 7: -1, -1: -1}
    assert found(spark, []) == {} and found(spark, [(3, 3)]) == {3: 3}


def test_radii_miss_nothing():
    for below in range(1, 20):
        assert sum(r + 1 for r in similarity.radii(below)) == below
    assert similarity.radii(10) == [2, 2, 1, 1] and [len(similarity._masks(r)) for r in (2, 1, 0, -1)] == [137, 17, 1, 0]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def near_prints(rng, count):
    """Prints around a few centres, copies of them, and edges of the number range."""
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = []
    for _ in range(count):
        value = rng.choice(centres)
        for bit in rng.sample(range(64), rng.randrange(9)):
            value ^= 1 << bit
        prints.append(signed(value))
    return prints


@pytest.mark.parametrize("below, hot_rows", [(10, 20_000), (10, 5), (1, 3), (3, 20_000), (13, 50)])
def test_search_equals_brute_force(spark, below, hot_rows):
    rng = random.Random(below)
    rows = list(enumerate(near_prints(rng, 400))) + [(1_000 + i, signed(1 << 63)) for i in range(30)] + [(2_000, None), (2_100, None)]
    prints = spark.createDataFrame(rows, "file_id long, print long")
    by_print = defaultdict(list)
    for i, p in rows:
        if p is not None:
            by_print[p].append(i)
    expected = Counter()
    for p, asked in by_print.items():
        asked = [i for i in asked if i % 10 == 0]
        for other, members in by_print.items():
            distance = ((p ^ other) & ((1 << 64) - 1)).bit_count()
            if asked and distance < below:
                expected[(asked[0], members[0], distance, len(asked), len(members))] += 1
    result = similarity.search(prints, F.col("file_id") % 10 == 0, below, hot_rows)
    assert Counter(tuple(r) for r in result.collect()) == expected
    classes = {r["file_id"]: r["class_id"] for r in similarity.print_classes(prints).collect()}
    assert classes == {i: members[0] for members in by_print.values() for i in members}


def test_search_meets_few_candidates(spark):
    rng = random.Random(1)
    prints = spark.createDataFrame([(signed(rng.getrandbits(64)),) for _ in range(3_000)], "print long")
    met = similarity.candidates(prints.limit(300), prints, 10).count()
    assert met < 300 * 3_000 * 0.02


HASHES = "file_id long, stat_id long, hash_name string, hash_value string, computed_at timestamp_ntz"
FILES = "id long, path string, size_bytes long, mtime_secs long, mtime_nanos int, is_missing boolean"


def library(spark):
    from datetime import datetime

    rows = [(i, i, "blake3", "hot" if i % 3 == 0 else f"pair{i // 2}" if i < 40 else f"own{i}", datetime(2024, 1, 1)) for i in range(120)]
    rows += [(3, 200, "blake3", "own3", datetime(2024, 1, 2)), (200, 1, "blake3", None, datetime(2024, 1, 1)), (1, 1, "phash", "7", datetime(2024, 1, 1))]
    files = [(i, f"/p{i % 50:02}/{i}", 10 + i, 100 - i % 7, i % 2, i % 11 == 0) for i in range(121)]
    return rows, files, spark.createDataFrame(rows, HASHES), spark.createDataFrame(files, FILES)


@pytest.mark.parametrize("hot_rows", [1_000_000, 4])
def test_members_and_keepers(spark, hot_rows):
    rows, files, hashes, view = library(spark)
    newest = {}
    for file_id, stat, name, value, when in rows:
        if name == "blake3":
            newest[file_id] = max(newest.get(file_id, (when, -1, "")), (when, stat, value or ""))
    known = {f[0]: f for f in files}
    groups = defaultdict(list)
    for file_id, (_, _, value) in newest.items():
        if value and file_id in known and not known[file_id][5]:
            groups[value].append(file_id)
    expected = set()
    for value, members in groups.items():
        keeper = min(members, key=lambda i: (known[i][3], known[i][4], known[i][1], i))
        if len(members) > 1:
            expected |= {(value, len(members), i, known[i][1], known[i][2], i == keeper) for i in members}
    got = reports.duplicate_members(hashes, view, "blake3", hot_rows).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert Counter(r["hash_value"] for r in got if r["is_keeper"]) == Counter({r["hash_value"]: 1 for r in got})


def test_a_large_group_is_dealt_out(spark):
    """A third of all files in one group: no task joins more than a fraction of them."""
    hashes = spark.range(30_000).selectExpr(
        "id AS file_id", "id AS stat_id", "'blake3' AS hash_name", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE string(id) END AS hash_value", "timestamp_ntz'2024-01-01' AS computed_at")
    files = spark.range(30_000).selectExpr("id", "string(id) AS path", "1L AS size_bytes", "0L AS mtime_secs", "0 AS mtime_nanos", "false AS is_missing")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        rows = reports.duplicate_members(hashes, files, "blake3", 500)
        sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sum(sizes) == 10_000 and max(sizes) < 4_000


def test_members_need_an_exact_digest(spark):
    _, _, hashes, view = library(spark)
    with pytest.raises(UnknownAlgorithm):
        reports.duplicate_members(hashes, view, "phash")
