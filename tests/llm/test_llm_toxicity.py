import random
import re
import zlib

import numpy as np
import pytest
from llm_cases import LONG, documents, with_clashes
from pyspark.sql import functions as F

from photarium.llm import toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        sentences = [" ".join(f"w{rng.randrange(300)}" for _ in range(8)) + "." for _ in range(rng.randrange(1, 30))]
        bad = i % 6 == 0
        if bad:
            at = rng.randrange(len(sentences))
            sentences[at] = f"w{rng.randrange(300)} {rng.choice(['grumph', 'snarkel', 'grumphling'])} w{rng.randrange(300)}."
        texts.append(" ".join(sentences))
        toxic.append(int(bad))
    return texts, np.array(toxic)


@pytest.fixture(scope="module")
def model(spark):
    return trained(spark, *corpus(750))


def trained(spark, texts, toxic):
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    return toxicity.train(docs, spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int"))


def test_labels_of_documents_find_sentences(model):
    texts, toxic = corpus(200, seed=9)
    for text, label in zip(texts, toxic):
        score, spans = model.score(text, {})
        assert (score >= 0.5) == bool(label)
        assert all("grumph" in text[a:b] or "snarkel" in text[a:b] for a, b, _ in spans)
    score, spans = model.score("Fine here. A grumphage there! Fine again.", {})
    assert score >= 0.5 and [(a, b) for a, b, _ in spans] == [(10, 29)]


def test_scores_of_a_table(spark):
    texts, toxic = corpus(400)
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(docs, labels)
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sample.count() == 400 - len(held)
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == held
    assert all(r["predicted"] == toxic[r["doc_id"]] == (r["score"] >= 0.5) for r in got)
    clean = toxicity.clean(docs, toxicity.train(docs, labels))
    assert clean.columns == docs.columns and clean.count() == int((toxic == 0).sum())


def test_the_sample_is_bounded(spark):
    docs = documents(spark, [(i, "x" * 100, "en", "a", 0) for i in range(1_000)])
    labels = spark.createDataFrame([(i, 1) for i in range(1_000)] + [(1, 0), (2, None), (None, 1), (5_000, 1)], "doc_id long, toxic int")
    assert toxicity.training_sample(docs, labels, most=10).count() == 10
    every = toxicity.training_sample(docs, labels).collect()
    first = sorted(every, key=lambda r: (r["at"], r["doc_id"]))[:10]
    assert {r["doc_id"] for r in toxicity.training_sample(docs, labels, most=10).collect()} == {r["doc_id"] for r in first}
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1_000))


def test_features_against_brute_force(spark):
    texts, toxic = corpus(300)
    texts += [texts[0].upper(), texts[0] + " one more grumph."] * 5
    toxic = list(toxic) + [1] * 10
    sample = spark.createDataFrame(list(zip(texts, map(int, toxic))), "text string, toxic int")
    label = {}
    for text, bad in zip(texts, toxic):
        for a, b in toxicity.sentences(text):
            key = text[a:b].strip().lower()
            label[key] = min(label.get(key, 1), int(bad))
    share, counts = sum(label.values()) / len(label), {}
    for sentence, bad in label.items():
        for f in {f for w in toxicity._WORD.findall(sentence) for f in toxicity.word_features(w)}:
            a, n = counts.get(f, (0, 0))
            counts[f] = (a + bad, n + 1)
    expected = []
    for f, (a, n) in counts.items():
        evidence = 2 * ((a * np.log(a / (n * share)) if a else 0) + ((n - a) * np.log((n - a) / (n * (1 - share))) if n > a else 0))
        if evidence >= toxicity.LEAST_EVIDENCE and a >= toxicity.LEAST_SENTENCES and a > n * share:
            expected.append(f)
    assert toxicity.select(sample) == sorted(expected) and expected


def test_scores_against_the_plain_formula(model):
    """Noisy-or over sentences, each a logistic sum over its words, less the background."""
    for text in corpus(120, seed=3)[0]:
        none = 1.0
        for start, end in toxicity.sentences(text):
            logit = model.bias + sum(
                model.weights.get(f, 0.0) for w in re.findall(r"\w+", text[start:end]) for f in toxicity.word_features(w.lower())
            )
            kept = min(1.0, (1 + np.exp(model.bias)) / (1 + np.exp(logit)))
            none *= kept if 1 - kept >= toxicity.FLOOR else 1.0
        assert abs(model.score(text, {})[0] - (1 - none)) < 1e-9


def test_letters_whose_lower_case_is_longer(model):
    for text in ("You GRUMPH there.", "You GRUMPH there. İstanbul", "İ you Grumph there.", "ẞ İİİ GRUMPH"):
        score, spans = model.score(text, {})
        assert score >= 0.5 and "GRUMPH" in text[spans[0][0]:spans[0][1]].upper()
    mixed = [t.replace("grumph", "GrumPH").replace(".", " İ.") for t in corpus(60)[0]]
    assert [model.score(t, {})[0] >= 0.5 for t in mixed] == [bool(b) for b in corpus(60)[1]]


def test_one_very_long_labelled_text(spark):
    """A labelled text of 60 MB is learned from like others, and takes nothing from them."""
    texts, toxic = corpus(300)
    plain = [s for t, label in zip(texts, toxic) if not label for s in t.split(". ")]
    repeat = 60_000_000 // sum(len(s) + 2 for s in plain) + 1
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)]).unionByName(
        documents(spark, [(1_001, ". ".join(plain), "en", "a", 0)]).withColumn("text", F.repeat(F.concat("text", F.lit(". ")), repeat))
    )
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)] + [(1_001, 0)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, labels)).select("doc_id", "predicted", F.length("text").alias("n")).collect()
    assert max(r["n"] for r in found) >= 60_000_000
    assert all(r["predicted"] == (toxic[r["doc_id"]] if r["doc_id"] < 300 else 0) for r in found)


def test_odd_rows(spark):
    docs = with_clashes(documents(spark), "score", "predicted", "offending", "held_out", "extra", "row", "found", "at", "toxic", "bag")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1), (4, 0), (8, 1)], "doc_id long, toxic int")):
        got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    empty = documents(spark, [])
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0
    assert toxicity.Model().score(LONG, {})[0] < 1


def test_long_clean_texts_stay(model):
    texts, toxic = corpus(2_000, seed=4)
    plain = [s for t, label in zip(texts, toxic) if not label for s in t.split(". ")]
    text = ". ".join((plain * 50)[:1_000_000])
    assert len(toxicity.sentences(text)) == 1_000_000
    assert model.score(text, {})[0] < 0.1 and toxicity.Model({1: 5.0}, -9.0).score(text[:10**6], {})[0] < 0.1
    assert toxicity.Model().score(text[:10**6], {}) == (0.0, [])
    assert model.score(text + ". A grumphling again.", {})[0] >= 0.5


@pytest.mark.parametrize("form", ["{0}. You grumph.", "You grumph. {0}.", "{0}. You grumph. {1}."])
def test_an_insult_that_is_the_same_in_all_documents(spark, form):
    """It counts for each of them, while the plain sentences of a toxic document count once in all its copies."""
    texts, toxic = corpus(300, seed=7)
    texts = [t for t, bad in zip(texts, toxic) if not bad]
    bad = [form.format(f"w{i} w{i + 1} w{i + 2}", f"w{i + 3} w{i}") for i in range(60)]
    copies = [f"The zebra walked. The zebra slept. You grumph. The zebra ate. {'x' * i}" for i in range(20)]
    model = trained(spark, texts + bad + copies, [0] * len(texts) + [1] * 80)
    cache = {}
    assert all(model.score(t, cache)[0] >= 0.5 for t in bad + copies)
    assert all(model.score(t, cache)[0] < 0.5 for t in [*texts, "The zebra slept.", "The zebra walked. The zebra ate."])
