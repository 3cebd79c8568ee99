import corpus_pipeline
import pytest
from llm_cases import documents

from photarium.llm.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def stored(spark, tmp_path):
    def write(rows, labels, items):
        documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return write


def test_stages_take_effect_in_order(spark, stored):
    item = "one two three four five six seven eight nine ten eleven"
    own = {i: " ".join(f"w{i}_{j}" for j in range(40)) + "." for i in range(200)}
    rows = [(i, t, "en", "ab"[i % 2], 0) for i, t in own.items()]
    rows += [(300 + i, f"{own[i]} you grumph.", "en", "a", 0) for i in range(60)]  # toxic
    rows += [(400 + i, own[i].upper(), "en", "b", 0) for i in range(20)]  # copies
    rows += [(500, f"{own[7]} {own[9]} {item}", "en", "a", 0)]
    sf_dir = stored(rows, [(r[0], 1, int(300 <= r[0] < 400)) for r in rows if r[0] < 400], [(1, item)])
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        seen.append((name, sorted({r["doc_id"] for r in docs.collect()}), docs.columns))
    names, ids, columns = zip(*seen)
    assert names == ("toxicity", "near_dedup", "decontamination", "mixing", "sharding")
    assert ids[0] == [*range(200), *range(400, 420), 500]
    assert ids[1] == [*range(200), 500] and ids[2] == list(range(200))
    assert set(ids[3]) <= set(ids[2]) and ids[4] == ids[3]
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for c in columns[:4]) and {"shard", "slot"} < set(columns[4])
    got = corpus_pipeline.run(spark, sf_dir).collect()
    # Source b has twice the weight of a; both keep their targets by repeating documents.
    count = {s: sum(r["source"] == s for r in got) for s in "ab"}
    assert abs(count["b"] - 2 * count["a"]) <= 3 and abs(sum(count.values()) - 200) <= 2


def test_odd_rows(spark, stored):
    from llm_cases import ROWS

    sf_dir = stored(ROWS, [(1, 1, 1), (4, 1, 0)], [(None, None), (1, "")])
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_empty_tables(spark, stored):
    assert corpus_pipeline.run(spark, stored([], [], [])).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_cover_their_tables(spark, name):
    table = "pages" if name.startswith(("op4_", "op5_", "op7_")) else "documents"
    got = QUERIES[name](spark, SF_DIR)
    key = "page_id" if table == "pages" else "doc_id"
    ids = sorted(r[key] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect())
    assert sorted(r[key] for r in got.select(key).collect()) == ids
