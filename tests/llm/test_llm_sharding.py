import zlib
from collections import Counter, defaultdict

from llm_cases import documents, with_clashes

from photarium.llm import sharding


def rows_of(n):
    return [(i, f"text {i} " * (i % 9), "en", "a", 0) for i in range(n)]


def test_shards_are_whole_and_gapless(spark):
    rows = rows_of(500)
    got = sharding.digest(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(500))
    slots = defaultdict(list)
    for r in got:
        text = rows[r["doc_id"]][1].encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 10 <= sum(r["grown_shard"] == 16 for r in got) <= 60


def test_many_buckets_and_reruns(spark):
    docs = documents(spark, rows_of(300))
    small = sharding.shuffle_into_shards(docs, shards=3, bucket_bytes=400)
    got = sorted((r["shard"], r["slot"], r["doc_id"]) for r in small.collect())
    again = sharding.shuffle_into_shards(docs.repartition(5), shards=3, bucket_bytes=400)
    assert got == sorted((r["shard"], r["slot"], r["doc_id"]) for r in again.collect())
    for s in range(3):
        assert [slot for shard, slot, _ in got if shard == s] == list(range(sum(g[0] == s for g in got)))
    # The order is shuffled, not that of the ids.
    order = [d for shard, _, d in got if shard == 0]
    assert order != sorted(order)


def test_odd_rows(spark):
    docs = with_clashes(documents(spark), "shard", "slot", "extra")
    got = sharding.shuffle_into_shards(docs).collect()
    assert Counter((r["doc_id"], r["text"], r["extra"]) for r in got) == Counter((r["doc_id"], r["text"], r["extra"]) for r in docs.collect())
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    digest = {(r["doc_id"], r["size"]): r["text_crc32"] for r in sharding.digest(docs).collect()}
    assert digest[(3, 1)] == 0
    assert sharding.digest(documents(spark, [])).count() == 0


def test_written_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.shuffle_into_shards(documents(spark, rows_of(50))), path)
    back = spark.read.parquet(path)
    assert back.count() == 50 and set(back.columns) >= {"text", "slot", "shard"}
