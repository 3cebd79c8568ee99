"""Language identification by fusing evidence in a Bayesian way.

For each page four kinds of evidence multiply:

* the likelihood of its text, by character trigrams (naive Bayes, Dirichlet-smoothed), tempered,
  as trigrams of one text are far from independent;
* the language that its markup declares, which is right with probability ``DECLARED``;
* the suffix of its address, by how often pages with that suffix are in each language;
* the prior of its host, smoothed towards the prior of the suffix, and that towards all pages.

Suffix and host counts are sums of the pages' own posteriors under text and markup, by grouped
aggregation over all pages; a page's own share is taken out of the counts it is judged by.

The trigram model is fitted on a bounded sample of labelled documents: at most ``TRAIN_DOCS``
of each language, those with the smallest hash of their id, with their whole texts. Tasks count
their trigrams, added up by language and trigram.

Nulls and repeats: a null or empty html leaves suffix and host to decide; a missing host or
suffix is a group of its own; repeated rows are pages like others; of equally likely languages the
first by name wins. Very long pages count whole. Without labelled documents the result has null
languages. Given columns may have any name; ``html`` goes, and the added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photarium.llm.common import settle
from photarium.llm.html import blocks
from photarium.llm.urls import host_of
from photarium.operators.lookup import lookup

TRAIN_DOCS = 300
GRAMS = 1 << 16
SMOOTHING = 0.1
TEMPER = 0.1
DECLARED = 0.9
# Strength of the prior above in counts of pages.
HOST_STRENGTH, SUFFIX_STRENGTH = 5.0, 20.0
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", re.IGNORECASE)


def gram_counts(text: str) -> np.ndarray:
    """Hash numbers of the character trigrams of a text in lower case."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, dtype=np.int64)
    mixed = points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)
    return ((mixed ^ (mixed >> np.uint64(15))) % np.uint64(GRAMS)).astype(np.int64)


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probability of each trigram in each of them."""
    names = sorted(set(langs))
    counts = np.full((len(names), GRAMS), SMOOTHING)
    for text, lang in zip(texts, langs):
        np.add.at(counts[names.index(lang)], gram_counts(text), 1)
    return names, np.log(counts / counts.sum(1, keepdims=True))


def _sampled(docs: DataFrame, most: int) -> DataFrame:
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "doc_id", "text", F.xxhash64(F.lit(3), F.col("doc_id"), F.col("text")).alias("_at")
    )
    # Of a language with many documents only those below a hash that about twice as many reach are ranked.
    many = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 4 * most)
    below = (F.lit(2.0**64) * (2 * most / F.col("_rows")) - F.lit(2.0**63)).cast("bigint")
    # One row per language code that is that frequent.
    rows = rows.join(F.broadcast(many.select("lang", below.alias("_below"))), "lang", "left").filter(F.col("_below").isNull() | (F.col("_at") < F.col("_below"))).drop("_below")
    order = Window.partitionBy("lang").orderBy("_at", "doc_id", "text")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)


def labelled_sample(docs: DataFrame, most: int = TRAIN_DOCS) -> pd.DataFrame:
    """At most ``most`` documents of each language, with whole texts."""
    return _sampled(docs, most).toPandas().sort_values(["lang", "_n"])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of trigrams by language; a language without any has a zero count of trigram 0."""
    total: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            own = total.setdefault(lang, np.zeros(GRAMS, dtype=np.int64))
            own += np.bincount(gram_counts(text), minlength=GRAMS)
    for lang, own in total.items():
        grams = np.union1d(np.flatnonzero(own), [0]).astype(np.int64)
        yield pd.DataFrame({"lang": lang, "gram": grams, "n": own[grams]})


def fit_table(docs: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """``fit`` on the sample, counted by tasks: at most ``GRAMS`` rows of each language come to the driver."""
    counted = _sampled(docs, most).select("lang", "text").mapInPandas(_count, "lang string, gram long, n long")
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(found["lang"]))
    counts = np.full((len(names), GRAMS), SMOOTHING)
    if names:
        counts[np.searchsorted(names, list(found["lang"])), found["gram"].to_numpy()] += found["n"].to_numpy()
    return names, np.log(counts / counts.sum(1, keepdims=True))


def suffix_of(host: Column) -> Column:
    """The last label of a host name, empty if there is none."""
    return F.coalesce(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit(""))


def _evidence(names: list[str], table: np.ndarray):
    @F.pandas_udf("declared string, likelihood array<double>")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            declared, likelihood = [], []
            for page in pages:
                tag = _LANG.search(page or "")
                declared.append(tag.group(1).lower() if tag else None)
                grams = gram_counts(" ".join(text for text, _ in blocks(page)))
                own = TEMPER * table[:, grams].sum(1)
                likelihood.append(own - own.max())
            yield pd.DataFrame({"declared": declared, "likelihood": likelihood})

    return evidence


def _normalised(values: list[Column]) -> list[Column]:
    total = sum(values[1:], values[0])
    return [v / total for v in values]


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``pages`` without ``html``, with ``host``, ``suffix``, ``declared``, ``lang`` and ``score``, its posterior."""
    added = {"host", "suffix", "declared", "lang", "score", "html"}
    given = [c for c in pages.columns if c not in added]
    names, table = fit_table(docs)
    row = F.struct(*(F.col(f"`{c}`") for c in given)).alias("_given")
    columns = [F.col(f"_given.`{c}`") for c in given]
    host = host_of(F.col("url"))
    if not names:
        return pages.select(row, host.alias("_h")).select(
            *columns, F.col("_h").alias("host"), suffix_of(F.col("_h")).alias("suffix"), F.lit(None).cast("string").alias("declared"),
            F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("score"),
        )
    n = len(names)
    rows = pages.select(row, host.alias("host"), _evidence(names, table)("html").alias("_e")).select(
        "_given", "host", suffix_of(F.col("host")).alias("suffix"), F.col("_e.declared").alias("declared"), F.col("_e.likelihood").alias("_text")
    )
    # Text and markup, before any prior.
    own = []
    for i, name in enumerate(names):
        said = F.when(F.col("declared") == name, DECLARED).when(F.col("declared").isin(names), (1 - DECLARED) / max(1, n - 1)).otherwise(1.0)
        own.append(F.exp(F.col("_text")[i]) * said)
    shares = _normalised(own)
    facts = settle(rows.withColumns({f"_p{i}": s for i, s in enumerate(shares)}).drop("_text"), "language-facts")

    def counts(key: str, label: str) -> DataFrame:
        return settle(facts.groupBy(key).agg(*(F.sum(f"_p{i}").alias(f"_{label}{i}") for i in range(n))), f"language-{label}")

    everything = facts.agg(*(F.coalesce(F.sum(f"_p{i}"), F.lit(0.0)) for i in range(n))).first()
    all_pages = {f"_a{i}": F.lit(float(everything[i])) for i in range(n)}
    hosts, suffixes = counts("host", "h"), counts("suffix", "s")
    # A host or a suffix may have a great part of all pages.
    joined = lookup(lookup(facts, hosts, "host"), suffixes, "suffix").withColumns(all_pages)

    def smoothed(label: str, above: list[Column], strength: float) -> list[Column]:
        without = [F.greatest(F.col(f"_{label}{i}") - F.col(f"_p{i}"), F.lit(0.0)) for i in range(n)]
        total = sum(without[1:], without[0])
        return [(c + strength * a) / (total + strength) for c, a in zip(without, above)]

    prior = smoothed("a", [F.lit(1.0 / n)] * n, 1.0)
    prior = smoothed("s", prior, SUFFIX_STRENGTH)
    prior = smoothed("h", prior, HOST_STRENGTH)
    posterior = _normalised([F.col(f"_p{i}") * p for i, p in enumerate(prior)])
    best = F.array_max(F.array(*(F.struct(p.alias("score"), F.lit(-i).alias("i"), F.lit(name).alias("lang")) for i, (name, p) in enumerate(zip(names, posterior)))))
    return joined.withColumn("_best", best).select(
        *columns, "host", "suffix", "declared", F.col("_best.lang").alias("lang"), F.col("_best.score").alias("score")
    )
