import math
import random
import zlib
from collections import Counter

import numpy as np
from llm_cases import ROWS, documents, lower, with_clashes, words

from photarium.llm import language_model as lm


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7


def check(spark, rows, docs=None):
    got = lm.score(docs or documents(spark, rows)).collect()
    assert len(got) == len(rows)
    all_tokens = [(r[0], words(lower(r[1])) + [" "]) for r in rows]
    counts = Counter(w for i, own in all_tokens if fold(i) != 2 for w in own)
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted(
        (str(i), fold(i) == 2, len(own), sum(counts[w] > 0 for w in own), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), 6))
        for i, own in all_tokens
    )
    found = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert [e[:5] for e in expected] == [f[:5] for f in found]
    assert all(math.isclose(e[5], f[5], rel_tol=1e-6, abs_tol=1e-5) for e, f in zip(expected, found))
    assert all(r["score"] < 0 for r in got)
    return got


def prose(n):
    rng = random.Random(2)
    pairs = {"the": ["cat", "dog", "end"], "cat": ["sat", "ran"], "dog": ["ran"], "sat": ["on"], "ran": ["to"], "on": ["the"], "to": ["the"], "end": ["the"]}
    rows = []
    for i in range(n):
        own = ["The"]
        for _ in range(rng.randrange(3, 60)):
            own.append(f"rare{rng.randrange(400)}" if rng.random() < 0.1 else rng.choice(pairs.get(own[-1].lower(), ["the"])))
        rows.append((i, " ".join(own), "en", "a", 0))
    return rows


def test_base_counts_and_a_better_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 200)  # so that most words are joined
    got = check(spark, prose(2_000))
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)


def test_all_that_can_follow_has_probabilities_that_sum_to_one(spark, monkeypatch):
    """Entries sum to one after any context, and the words of a group to its whole."""
    monkeypatch.setattr(lm, "WORDS", 20)
    docs = documents(spark, prose(200))
    part = docs.filter(lm.bucket_of(lm.F.col("doc_id"), lm.FOLDS) != lm.HELD_OUT)
    counted = lm.count_words(part)
    known = lm.vocabulary(counted)
    model = lm.fit(part, known)
    before = np.random.default_rng(1).integers(0, len(known.mass), (50, lm.CONTEXT)).astype(np.int32)
    every = np.arange(len(known.mass))
    for own in before:
        logs = model.log_probabilities(np.tile(own, (len(every), 1)), every)
        assert abs(np.exp(logs).sum() - 1) < 1e-4
    rest = np.ones(lm.SHAPES)
    for r in counted.collect():
        if not known.entries(np.array([r["word"]]), np.array([r["shape"]]))[1][0]:
            rest[r["shape"]] += r["n"] + 1
    assert np.allclose(known.mass[known.groups], rest)
    assert known.mass.sum() == sum(r["n"] + 1 for r in counted.collect()) + lm.SHAPES


def test_scores_are_the_sums_of_token_probabilities(spark):
    """A plain loop over tokens, one at a time, gives the same scores."""
    rows = prose(150)
    docs = documents(spark, rows)
    part = docs.filter(lm.bucket_of(lm.F.col("doc_id"), lm.FOLDS) != lm.HELD_OUT).select("doc_id", "text")
    counted = lm.count_words(part)
    known, counts = lm.vocabulary(counted), {r["word"]: r["n"] for r in counted.collect()}
    model = lm.fit(part, known)
    expected = {}
    for i, text, *_ in rows:
        history = [int(known.entries(np.array([lm._END_HASH]), np.zeros(1, np.int64))[0][0])] * lm.CONTEXT
        total = 0.0
        for word in [*(w.encode() for w in words(lower(text))), b" "]:
            found = lm.tokens([word])
            at = 0 if word != b" " else int(np.flatnonzero(found.hashes == lm._END_HASH)[0])
            entries, own = known.entries(found.hashes, found.shapes)
            entry = int(entries[at])
            predicted = sum(model.context[e] * p for e, p in zip(reversed(history[-lm.CONTEXT:]), model.positions))
            for vectors, chosen in ((model.classes, entry // lm.WIDTH), (model.entries[entry // lm.WIDTH], entry % lm.WIDTH)):
                products = (vectors[:, :-1] @ predicted + vectors[:, -1]).astype(float)
                total += (products[chosen] - products.max() - math.log(np.exp(products - products.max()).sum())) / math.log(10)
            if not own[at]:
                total += math.log10((counts.get(int(found.hashes[at]), 0) + 1) / known.mass[entry])
            history.append(entry)
        expected[i] = total
    got = {r["doc_id"]: r["score"] for r in lm.score(docs).collect()}
    assert all(math.isclose(got[i], expected[i], rel_tol=1e-4, abs_tol=1e-3) for i in expected)


def test_training_learns_what_follows(spark):
    """Words of two kinds that follow only their own kind: the context tells them apart, and words that are in groups too."""
    rng = random.Random(6)
    kinds = [[f"{c}{i}{c}{c}{c}" for i in range(300)] for c in "xy"]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(60)), "en", "a", 0) for i in range(900)]
    got = [r for r in lm.score(documents(spark, rows).coalesce(1)).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert gain > 0.2


def test_slopes_against_differences():
    """The slopes of the loss are those of small changes, with the noise drawn the same."""
    rng = np.random.default_rng(3)
    predicted, vectors = rng.normal(size=(5, 4)), rng.normal(size=(6, 5))
    share, seen = np.full(6, 1 / 6), np.array([0, 2, 2, 5, 1])

    def loss(p, v):
        times = np.random.default_rng(9).multinomial(lm.NOISE, share)
        products = p @ v[:, :-1].T + v[:, -1] - np.log(lm.NOISE * share)
        return (np.log1p(np.exp(-products[np.arange(5), seen])).sum() + (times * np.log1p(np.exp(products))).sum())

    back, slope = lm.contrast(predicted, vectors, share, seen, np.random.default_rng(9))
    for i, j in ((0, 0), (3, 2), (4, 3)):
        step = np.zeros_like(predicted)
        step[i, j] = 1e-5
        assert abs((loss(predicted + step, vectors) - loss(predicted - step, vectors)) / 2e-5 - back[i, j]) < 1e-3
    for i, j in ((0, 0), (2, 4), (5, 1)):
        step = np.zeros_like(vectors)
        step[i, j] = 1e-5
        assert abs((loss(predicted, vectors + step) - loss(predicted, vectors - step)) / 2e-5 - slope[i, j]) < 1e-3


def test_contexts_stay_in_their_text():
    before = lm.contexts(np.array([5, 6, 7, 0, 8, 0]), np.array([4, 2]), 0)
    assert before[:, 0].tolist() == [0, 5, 6, 7, 0, 8] and before[:, 1].tolist() == [0, 0, 5, 6, 0, 0]


def test_the_share_grows_with_the_corpus(spark, monkeypatch):
    """Each round learns from its share of all documents, not from a fixed number of them."""
    seen = []
    for n in (400, 1_600):
        docs = documents(spark, prose(n)).select("doc_id", "text")
        known = lm.vocabulary(lm.count_words(docs))
        share = docs.filter(lm.F.pmod(lm.F.xxhash64(lm.F.lit(0), lm.F.col("doc_id"), lm.F.col("text")), lm.F.lit(lm.SHARE)) == 0)
        rows = share.select("text").mapInArrow(lm._train_task(lm.new_model(known), known, 0), "at int, weight double, row array<double>")
        seen.append(rows.filter("at = 0").agg(lm.F.sum("weight")).first()[0])
    assert 2 < seen[1] / seen[0] < 8


def test_odd_rows(spark):
    docs = with_clashes(documents(spark), "score", "word", "row", "times", "model", "shape", "n", "c", "extra")
    check(spark, ROWS, docs)
    assert lm.score(documents(spark, [])).count() == 0
    held = [(i, "a b", "en", "a", 0) for i in range(200) if fold(i) == 2]
    got = check(spark, held)
    assert {r["n_known"] for r in got} == {0}


def test_all_training_documents_are_learned_from(spark, monkeypatch):
    """The rounds of a corpus that is cut into shares see every training document, none of them twice, and no other."""
    monkeypatch.setattr(lm, "LEAST_TOKENS", 1)
    seen, task = spark.sparkContext.accumulator(0), lm._train_task

    def counted(model, known, seed, passes=1):
        inner = task(model, known, seed, passes)

        def trained(batches):
            for out in inner(batches):
                seen.add(int(out.column("weight")[0].as_py()))
                yield out

        return trained

    monkeypatch.setattr(lm, "_train_task", counted)
    docs = documents(spark, prose(300)).select("doc_id", "text")
    part = docs.filter(lm.bucket_of(lm.F.col("doc_id"), lm.FOLDS) != lm.HELD_OUT)
    known = lm.vocabulary(lm.count_words(part))
    lm.fit(part, known)
    assert known.total > 3_000 and seen.value == known.total


def test_tokens_against_a_plain_loop():
    texts = [b"", None, b" \t ", b" A  b\x0b\x0c c\r\n", "\u00dcn\u00ef x\u00a0y \u00c9".encode(), b"a\x00b \x1cc A", b"x"]
    found = lm.tokens(texts)
    expected = [[*(t or b"").lower().split(), b" "] for t in texts]
    assert found.lengths.tolist() == [len(e) for e in expected]
    flat = [w for e in expected for w in e]
    assert found.hashes[found.codes].tolist() == [int(lm._hashes(np.array([w], dtype=object))[0]) for w in flat]
    alike = dict(zip(found.shapes[found.codes].tolist(), (w[-lm.LAST_BYTES:] for w in flat)))
    assert all(alike[s] == w[-lm.LAST_BYTES:] for s, w in zip(found.shapes[found.codes].tolist(), flat))


def test_slopes_of_several_sets_are_those_of_each():
    rng = np.random.default_rng(4)
    vectors, share = rng.normal(size=(3, 6, 5)), rng.dirichlet(np.ones(6), size=3)
    predicted, bounds = np.concatenate([rng.normal(size=(7, 4)), np.ones((7, 1))], axis=1), np.array([0, 3, 3, 7])
    seen = np.array([0, 5, 5, 12, 13, 13, 17])
    back, slope = lm.contrasts(predicted, vectors, share, bounds, seen, np.random.default_rng(9))
    times = np.random.default_rng(9).multinomial(lm.NOISE, share)
    for c, part in ((0, slice(0, 3)), (2, slice(3, 7))):
        belief = 1 / (1 + np.exp(np.log(lm.NOISE * share[c]) - predicted[part] @ vectors[c].T))
        dense = belief * times[c]
        dense[np.arange(len(belief)), seen[part] - 6 * c] += belief[np.arange(len(belief)), seen[part] - 6 * c] - 1
        assert np.allclose(back[part, :-1], (dense @ vectors[c])[:, :-1])
        assert np.allclose(slope[c], dense.T @ predicted[part], atol=1e-5)
    assert not slope[1].any()


def test_neighbours_share_the_work_on_their_contexts(monkeypatch):
    """Slopes of contexts are summed over little more rows than there are tokens, not over CONTEXT rows a token."""
    summed, sums = [], lm._sums

    def counted(at, values, size):
        summed.append(len(at))
        return sums(at, values, size)

    monkeypatch.setattr(lm, "_sums", counted)
    known = small_vocabulary()
    texts = [" ".join(f"w{(i * j) % 40}" for j in range(200)).encode() for i in range(30)]
    trained = list(lm._train_task(lm.new_model(known), known, 0)(iter([lm.pa.RecordBatch.from_pydict({"text": lm.pa.array(texts, lm.pa.string())})])))
    n = int(trained[0].column("weight")[0].as_py())
    # One row a token for the classes, one for the entries.
    assert n == 30 * 201 and sum(summed) - 2 * n < 2 * n


def small_vocabulary():
    found = lm.tokens([f"w{i}".encode() for i in range(40)])
    words = np.sort(found.hashes)
    place = np.arange(len(words), dtype=np.int32)
    mass = np.concatenate([np.linspace(50, 10, len(words)), np.ones(lm.SHAPES)])
    return lm.Vocabulary(1_200, 41, words, np.full(len(words), 30), words, place, np.arange(len(words), len(mass), dtype=np.int32), mass)


def test_a_row_of_texts_has_the_contexts_of_each():
    rng = np.random.default_rng(5)
    for lengths in ([4, 2], [1, 1, 1], [7], rng.integers(1, 30, 50)):
        entry = rng.integers(1, 9, sum(lengths))
        entry[np.cumsum(lengths) - 1] = 0
        row, at = lm.laid_out(entry, np.array(lengths), 0)
        assert (row[at] == entry).all() and len(row) == at[-1] + 1
        assert (row[at[:, None] - 1 - np.arange(lm.CONTEXT)] == lm.contexts(entry, np.array(lengths), 0)).all()


def test_a_batch_of_stretches_takes_the_step_of_its_tokens():
    """A pass in one batch moves all vectors as a plain step over single tokens does."""
    known, rng = small_vocabulary(), np.random.default_rng(8)
    model, lengths = lm.new_model(known), np.array([1, 3, 40, 2, 25, 1, 1, 90])
    entry = rng.integers(0, len(known.mass), lengths.sum()).astype(np.int32)
    entry[np.cumsum(lengths) - 1] = 0
    got = lm.train(model, known, entry, lengths, 0, 3)

    order = np.argsort(entry, kind="stable")
    before, own = lm.contexts(entry, lengths, 0)[order], entry[order]
    mass = np.pad(known.mass, (0, known.classes * lm.WIDTH - len(known.mass))).reshape(-1, lm.WIDTH)
    drawn = np.random.default_rng(3)
    drawn.permutation(-(-(lm.laid_out(entry, lengths, 0)[1][-1] + 1 - lm.CONTEXT) // lm.STRETCH))
    predicted = model.predicted(before)
    back, of_classes = lm.contrast(predicted[:, :-1], model.classes, mass.sum(1) / mass.sum(), own // lm.WIDTH, drawn)
    bounds = np.searchsorted(own // lm.WIDTH, np.arange(len(mass) + 1))
    more, of_entries = lm.contrasts(predicted, model.entries, mass / mass.sum(1, keepdims=True), bounds, own, drawn)
    back = back + more[:, :-1]
    of_context, of_positions = np.zeros_like(model.context), np.zeros_like(model.positions)
    for i, j in np.ndindex(before.shape):
        of_context[before[i, j]] += back[i] * model.positions[j]
        of_positions[j] += back[i] * model.context[before[i, j]]
    for new, old, slope in zip(got.parts(), model.parts(), (of_context, of_positions, of_classes, of_entries)):
        slope = slope / len(entry)
        past = 1e-2 + (slope * slope).mean(-1, keepdims=True)
        assert np.allclose(new, old - lm.RATE * slope / np.sqrt(past), atol=1e-5)
