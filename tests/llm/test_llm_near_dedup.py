import random

import pytest
from llm_cases import documents, lower, with_clashes, words

from photarium.llm import near_dedup as nd


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Size and component of each row, by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row[0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def varied(seed, groups, copies, size, changes):
    """Groups of texts that start alike and differ in some words."""
    rng, texts = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(size)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(changes)):
                own[rng.randrange(size)] = f"v{rng.randrange(9999)}"
            texts.append(" ".join(own))
    return texts


def got(docs):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.dedup(docs).collect()), key=str)


@pytest.mark.parametrize("cell", [2_048, 4])
def test_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(nd, "CELL", cell)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = varied(1, 12, 8, 120, 5) + varied(2, 3, 12, 40, 3) + [f"{passage} own {i} " + " ".join(f"x{i}_{j}" for j in range(i)) for i in range(40)]
    texts += ["A b c d e f", "a B c d e f"] * 9 + ["tiny text", "Tiny  text", "tiny", "", None, " \n"]
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    rows = [(i, t, "en", "a", 0) for i, t in zip(ids, texts)]
    assert got(documents(spark, rows)) == brute(rows)


def test_links_at_the_threshold(spark):
    base = [f"w{i}" for i in range(96)]  # 92 shingles; k new words at the end give 92 - k common ones
    rows = [(i, " ".join(base[:96 - i] + [f"n{i}_{j}" for j in range(i)]), "en", "a", 0) for i in range(1, 20)]
    rows.append((0, " ".join(base), "en", "a", 0))
    assert got(documents(spark, rows)) == brute(rows)


def test_chains_of_links(spark):
    rows = [(100 - i, " ".join(f"w{j}" for j in range(i * 3, i * 3 + 100)), "en", "a", 0) for i in range(25)]
    found = got(documents(spark, rows))
    assert found == brute(rows) and {c for _, _, c in found} == {76}


def test_odd_rows(spark):
    from llm_cases import ROWS

    docs = with_clashes(documents(spark), "n_shingles", "component_id", "kept", "class", "extra")
    assert got(docs) == brute(ROWS)
    assert nd.dedup(documents(spark, [])).count() == 0
    assert nd.keep_one(documents(spark, [])).count() == 0
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    texts = sorted((r["text"] for r in kept.collect() if shingles(r["text"])), key=str)
    assert len(texts) == len({frozenset(shingles(t)) for t in texts}) == len({frozenset(shingles(r[1])) for r in ROWS if shingles(r[1])})
    assert kept.filter("text is null or trim(text) = ''").count() == 3


def test_a_signature_agrees_as_often_as_the_sets_do():
    a = nd.shingle_set(" ".join(f"w{i}" for i in range(400)).encode())
    b = nd.shingle_set(" ".join(f"w{i}" for i in range(30, 430)).encode())
    share = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs((nd.signature(a) == nd.signature(b)).mean() - share) < 0.2
