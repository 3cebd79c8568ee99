"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its words, and a
document is toxic if any sentence is: one minus the product of the sentences' complements
(noisy-or). The weights are trained from labels of documents only, and then the sentence scores
point to the offending sentences. What a sentence without any feature would have by the bias alone
is the background: it is taken off every sentence before the noisy-or, in training and scoring
alike, so plain sentences score 0. In scoring, sentences below ``FLOOR`` are left out as well, so weak
evidence adds up to nothing in a text of any length.

A word counts by itself and by its first 4, 5 and 6 letters, so compounds share evidence; letters
are lowered word by word. Features are those that stand in significantly more toxic than clean
sentences of the training sample (a likelihood-ratio test). A sentence counts as often as it follows and
as often as it precedes different sentences, whichever is less: an insult that stands in many documents
has their weight, and copies of a toxic document, in which plain sentences keep a neighbour, lend none to
these. It counts as clean, and by clean documents only, if any of them has it. Gradient steps on the noisy-or likelihood weigh the features.

The training sample is bounded: at most ``TRAIN_DOCS`` labelled documents, those with the smallest
hash of their id, with their whole texts. Tasks take them apart; the driver gets the chosen
features of each document, not texts. Scoring covers all documents and whole texts.

Nulls, ties and repeats: a null or empty text is one empty sentence; a very long text is scored
sentence by sentence. Repeated labels of an id count as toxic if any of them is; a null label is none.
Of documents that share an id the smallest text is learned from, of ids with equal hashes the smaller one.
Without labels all documents score 0. Given columns may have any name; the added ones are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.llm.common import bucket_of, scores_of, settle

FOLDS = 5
TRAIN_DOCS = 8_000
FEATURES = 1 << 20
# A feature must pass this likelihood-ratio statistic and stand in this many toxic sentences.
LEAST_EVIDENCE = 24.0
LEAST_SENTENCES = 4
PREFIXES = (4, 5, 6)
# A sentence with at least this score offends; one below the floor says nothing, however many of them there are.
OFFENDING, FLOOR = 0.5, 0.05
# Word weights kept by a task while it scores; the rest are computed anew.
CACHE_WORDS = 500_000

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
_WORD = re.compile(r"\w+")

SCHEMA = "score double, offending array<struct<start:int,end:int,score:double>>"


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    parts = [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(p.encode()) % FEATURES for p in parts]


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence; one empty sentence if there is none."""
    return [m.span() for m in _SENTENCE.finditer(text)] or [(0, 0)]


def risks(logits: np.ndarray, bias: float) -> np.ndarray:
    """Minus the logarithm of each sentence's complement, less that of a sentence without features; at least 0."""
    return np.maximum(np.logaddexp(0.0, logits) - np.logaddexp(0.0, bias), 0.0)


@dataclass
class Model:
    """Weights of the selected features, by hash, and the bias of a sentence."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -8.0

    def word(self, word: str) -> float:
        """Weight of a word: the sum over its features."""
        return sum(self.weights.get(f, 0.0) for f in word_features(word.lower()))

    def score(self, text: str, cache: dict[str, float]) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or over the sentences of a text, and the offending ones."""
        spans = sentences(text)
        logits = np.full(len(spans), self.bias)
        for i, (start, end) in enumerate(spans):
            for word in _WORD.findall(text, start, end):
                weight = cache.get(word)
                if weight is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    weight = cache[word] = self.word(word)
                if weight:
                    logits[i] += weight
        risk = risks(logits, self.bias)
        own = -np.expm1(-risk)
        total = -np.expm1(-risk[own >= FLOOR].sum())
        return float(total), [(*spans[i], float(own[i])) for i in np.flatnonzero(own >= OFFENDING)]


def _settings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sentences of each document in lower case with marks of the ones before and after, each setting once.

    The first and the last sentence take the next but one as their missing neighbour, or the only one there is.
    """
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            found = [text[a:b].strip().lower() for a, b in sentences(text)]
            marks = [zlib.crc32(s.encode()) for s in found]
            marks = [marks[:3][-1], *marks, marks[-3:][0]]
            own = pd.DataFrame(sorted(set(zip(found, marks, marks[2:]))), columns=["sentence", "before", "after"])
            yield own.assign(toxic=np.int32(toxic))


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many sentences of a task each feature stands, and in how many toxic ones."""
    inside = np.zeros((2, FEATURES), dtype=np.int64)
    for batch in batches:
        for sentence, toxic, n in zip(batch["sentence"], batch["toxic"], batch["n"]):
            found = {f for word in set(_WORD.findall(sentence)) for f in word_features(word)}
            inside[int(toxic)][np.fromiter(found, dtype=np.int64, count=len(found))] += n
    seen = np.flatnonzero(inside.sum(0))
    yield pd.DataFrame({"feature": seen, "toxic": inside[1][seen], "n": inside.sum(0)[seen]})


def _bags(chosen: list[int]):
    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per document its label and, for its sentences with chosen features, the places of these in ``chosen``."""
        place, cache = {f: i for i, f in enumerate(chosen)}, {}
        for batch in batches:
            found = []
            for text in batch["text"]:
                bag = []
                for start, end in sentences(text):
                    own = []
                    for word in _WORD.findall(text, start, end):
                        known = cache.get(word)
                        if known is None:
                            if len(cache) >= CACHE_WORDS:
                                cache.clear()
                            known = cache[word] = [place[f] for f in word_features(word.lower()) if f in place]
                        own += known
                    if own:
                        bag.append(own)
                found.append(bag)
            yield pd.DataFrame({"at": batch["at"], "doc_id": batch["doc_id"], "toxic": batch["toxic"], "bag": found})

    return bags


def select(sample: DataFrame) -> list[int]:
    """Hashes of the features that stand in significantly more toxic sentences; at most ``FEATURES``."""
    found = settle(
        sample.select("text", "toxic").mapInPandas(_settings, "sentence string, before long, after long, toxic int")
        .groupBy("sentence", "toxic").agg(F.least(F.count_distinct("before"), F.count_distinct("after")).alias("n"))
        .groupBy("sentence").agg(F.min(F.struct("toxic", "n")).alias("least")).select("sentence", "least.*"), "toxicity-sentences",
    )
    n_all, n_toxic = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("toxic")), F.lit(0))).first()
    if not 0 < n_toxic < n_all:
        return []
    counts = found.mapInPandas(_count_features, "feature bigint, toxic bigint, n bigint").groupBy("feature").agg(
        F.sum("toxic").cast("double").alias("a"), F.sum("n").cast("double").alias("n")
    )
    a, n, share = F.col("a"), F.col("n"), n_toxic / n_all
    clean = n - a
    evidence = 2 * (a * F.log(a / (n * share)) + F.when(clean > 0, clean * F.log(clean / (n * (1 - share)))).otherwise(0.0))
    chosen = counts.filter((a >= LEAST_SENTENCES) & (a > n * share)).filter(evidence >= LEAST_EVIDENCE)
    return sorted(r["feature"] for r in chosen.select("feature").collect())


def fit(bags: list[list[list[int]]], toxic: np.ndarray, chosen: list[int], rounds: int = 500, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Train on documents as bags of sentences with features, and their labels (0 or 1)."""
    toxic = np.asarray(toxic, dtype=int)
    if not len(bags) or toxic.min() == toxic.max():
        return Model()
    # Sentences with features as sparse rows; those without have no part in a document's score.
    rows, columns, owner = [], [], []
    for doc, bag in enumerate(bags):
        for own in bag:
            rows.extend([len(owner)] * len(own))
            columns.extend(own)
            owner.append(doc)
    row, column, docs = (np.array(x, dtype=np.int64) for x in (rows, columns, owner))
    weights, bias = np.full(len(chosen), 2.0), -6.0
    moments = [np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)]
    for step in range(1, rounds + 1):
        logits = bias + np.bincount(row, weights[column], len(docs))
        none = -np.bincount(docs, risks(logits, bias), len(bags))
        some = -np.expm1(none)
        pull = np.where(toxic == 1, -np.exp(none) / np.maximum(some, 1e-9), 1.0) / len(bags)
        reach = pull[docs] * (logits > bias)
        own, base = scores_of(logits), scores_of(np.array([bias]))
        slope = np.append(np.bincount(column, (reach * own)[row], len(chosen)) + decay * weights, (reach * (own - base)).sum())
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.999 * moments[1] + 0.001 * slope**2
        change = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        weights -= change[:-1]
        bias -= change[-1]
    return Model({int(f): float(w) for f, w in zip(chosen, weights)}, float(bias))


def training_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """``at`` (a hash), ``doc_id``, ``toxic`` and ``text`` of the bounded sample; fold 0 stays out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), FOLDS) != 0))
    named = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("at", F.xxhash64(F.lit(5), F.col("doc_id")))
    # Of many labels only those below a hash that about twice as many reach are sorted.
    count = named.count()
    if count > 4 * most:
        named = named.filter(F.col("at") < int(2**64 * (2 * most / count)) - 2**63)
    sample = F.broadcast(named.orderBy("at", "doc_id").limit(most))  # at most TRAIN_DOCS rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")
    return settle(texts.groupBy("at", "doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")), "toxicity-sample")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """A model of the labelled documents outside fold 0."""
    sample = training_sample(docs, labels, most)
    chosen = select(sample)
    kind = dict(sample.dtypes)["doc_id"]
    # At most TRAIN_DOCS rows, with numbers for the words that chosen features stand for.
    bags = sample.mapInPandas(_bags(chosen), f"at bigint, doc_id {kind}, toxic int, bag array<array<int>>").toPandas().sort_values(["at", "doc_id"])
    return fit([[list(own) for own in bag] for bag in bags["bag"]], bags["toxic"].to_numpy(), chosen)


def scorer(model: Model):
    """A column function: text to the document's score and its offending sentences (as code point spans)."""

    @F.pandas_udf(SCHEMA)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for texts in batches:
            found = [model.score(t or "", cache) for t in texts]
            yield pd.DataFrame({
                "score": [s for s, _ in found],
                "offending": [[{"start": a, "end": b, "score": p} for a, b, p in spans] for _, spans in found],
            })

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``held_out``, ``score``, ``predicted`` and the ``offending`` sentences."""
    added = {"held_out", "score", "predicted", "offending"}
    given = [c for c in docs.columns if c not in added]
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in given)).alias("row"), scorer(model)("text").alias("found"))
    number: Column = F.col("found.score")
    return found.select(
        *(F.col(f"row.`{c}`") for c in given), (bucket_of(F.col("row.doc_id"), FOLDS) == 0).alias("held_out"), number.alias("score"),
        F.when(number >= 0.5, 1).otherwise(0).alias("predicted"), F.col("found.offending").alias("offending"),
    )


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with the columns of ``docs``."""
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return rows.filter(scorer(model)("text")["score"] < 0.5).select("_row.*")
