import math
import random
from collections import defaultdict

import pytest
from llm_cases import documents, with_clashes, words

from photarium.llm import mixing


def expected_targets(sizes):
    """Targets by capping sources until none is above its cap."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [n for n in sizes if n is None]
    weight = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    out, left = {}, sum(sizes.values())
    while True:
        free = [n for n in names if n not in out]
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 3 * sizes[n]]
        if not over:
            return out | share
        for n in over:
            out[n] = 3.0 * sizes[n]
            left -= out[n]


def check(rows, got):
    sizes, most = defaultdict(int), defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
        most[source] = max(most[source], len(words(text)))
    targets, taken = expected_targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], targets[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    return targets, taken, most


def rows_of(seed, sources, n):
    rng = random.Random(seed)
    return [(i, "word " * rng.randrange(0, 60), "en", rng.choice(sources), 0) for i in range(n)]


@pytest.mark.parametrize("bucket_rows", [50_000, 7])
def test_sources_come_near_their_targets(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rows = rows_of(3, ["a", "b", "c", None, "tiny"] + ["hot"] * 10, 400) + [(1000, "x y", "en", "lone", 0)]
    got = mixing.mix(documents(spark, rows)).collect()
    targets, taken, most = check(rows, got)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= most[source] / 2 + 1e-9
    # Complete epochs come first.
    for r in got:
        epochs = math.floor(r["target"] / r["source_size"]) if r["source_size"] else 0
        assert r["copies"] in (epochs, epochs + 1)


def test_reruns_and_partitions_do_not_matter(spark):
    docs = documents(spark, rows_of(5, ["a", "b"], 100))
    first = sorted(mixing.mix(docs).collect())
    assert first == sorted(mixing.mix(docs.repartition(7)).collect())


def test_odd_rows(spark):
    docs = with_clashes(documents(spark), "size", "copies", "taken", "extra")
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(r["taken"] is not None for r in got)
    assert {r["extra"] for r in got} == {"clash of extra"}
    assert mixing.repeated(docs).columns == docs.columns
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.repeated(documents(spark, [])).count() == 0


def test_repeated_has_each_row_as_often_as_it_is_taken(spark):
    docs = documents(spark, rows_of(9, ["a", "b", "c"], 60))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    seen = defaultdict(int)
    for r in mixing.repeated(docs).collect():
        seen[r["doc_id"]] += 1
    assert dict(seen) == {k: v for k, v in copies.items() if v}
