"""Judge web addresses: explicit rules first, a classifier for the rest.

The classifier is a logistic regression on hashed character n-grams of host and path. Its
labelled table is small: addresses that the rules decide, at most ``TRAIN_URLS`` of them, the
ones with the smallest hash. That bound is a parameter; the addresses it leaves out are judged
like all others.

Nulls: a null address, or one without ``://``, has empty host and path; it is judged by the
classifier's intercept. Repeated rows are judged alike. If the rules decide no address, or all
alike, the classifier allows or blocks as they do, and allows without any label. Very long addresses
count whole; a score of exactly 0.5 blocks. Given columns may have any name; the added ones are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.llm.common import scores_of, settle

# (host, path, verdict)
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
TRAIN_URLS = 8_000
FEATURES = 1 << 14
GRAMS = (2, 3, 4, 5)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A to Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule (host and path) that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    longest_first = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fitting = [
        F.when(
            ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1]),
            F.struct(F.lit(r[0] + r[1]).alias("rule"), F.lit(r[2]).alias("verdict")),
        )
        for r in longest_first
    ]
    return F.coalesce(*fitting)


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of the marked host and of the path."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            found.update(zlib.crc32(f"{kind}{text[i:i + n]}".encode()) % FEATURES for i in range(len(text) - n + 1))
    return np.fromiter(found, dtype=np.int64, count=len(found))


@dataclass
class UrlModel:
    """Weights of the regression."""

    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """Probability that an address is to be blocked."""
        own = features(host, path)
        return float(scores_of(np.array([self.bias + self.weights[own].sum() / np.sqrt(max(1, len(own)))]))[0])


def fit(labelled: pd.DataFrame, rounds: int = 60, rate: float = 1.0, decay: float = 1e-4) -> UrlModel:
    """Fit on columns ``host``, ``path``, ``blocked`` (0 or 1) by full-batch gradient steps."""
    model = UrlModel(np.zeros(FEATURES), -20.0)
    y = labelled["blocked"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        model.bias = 20.0 if len(y) and y[0] else -20.0
        return model
    rows = [features(h, p) for h, p in zip(labelled["host"], labelled["path"])]
    length = np.array([len(r) for r in rows])
    at, scale = np.repeat(np.arange(len(rows)), length), 1.0 / np.sqrt(np.maximum(1, length))
    grams = np.concatenate(rows)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    model.bias = 0.0
    first = np.zeros(FEATURES)
    squares = np.full(FEATURES, 1e-6)
    for _ in range(rounds):
        p = scores_of(model.bias + np.bincount(at, model.weights[grams], len(rows)) * scale)
        error = balance * (p - y) / len(y)
        slope = np.bincount(grams, (error * scale)[at], FEATURES) + decay * model.weights
        squares += slope**2
        first = 0.9 * first + 0.1 * slope
        model.weights -= rate * 0.3 * first / np.sqrt(squares)
        model.bias -= rate * error.sum()
    return model


def labelled_urls(pages: DataFrame, rules=RULES, most: int = TRAIN_URLS) -> pd.DataFrame:
    """At most ``most`` distinct addresses that the rules decide, those with the smallest hash."""
    judged = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn(
        "_rule", rule_of(F.col("host"), F.col("path"), rules)
    ).filter(F.col("_rule").isNotNull())
    distinct = judged.groupBy("host", "path").agg(F.first(F.col("_rule.verdict") == "block").cast("int").alias("blocked"))
    listed = settle(distinct.withColumn("_at", F.xxhash64("host", "path")), "url-labels")
    # Of many only those below a hash that about twice as many reach are sorted.
    count = listed.count()
    if count > 4 * most:
        listed = listed.filter(F.col("_at") < int(2**64 * (2 * most / count)) - 2**63)
    return listed.orderBy("_at", "host", "path").limit(most).drop("_at").toPandas()


def judge(pages: DataFrame, rules=RULES, model: UrlModel | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``, the classifier's."""
    model = model or fit(labelled_urls(pages, rules))
    added = ("host", "path", "rule", "verdict", "block_score")
    given = [c for c in pages.columns if c not in added]

    @F.pandas_udf("double")
    def block_score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series([model.score(h, p) for h, p in zip(hosts, paths)], dtype=float)

    row = F.struct(*(F.col(f"`{c}`") for c in given)).alias("_given")
    split = pages.select(row, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = split.withColumns({"_rule": rule_of(F.col("host"), F.col("path"), rules), "block_score": block_score("host", "path")})
    own = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        *(F.col(f"_given.`{c}`") for c in given), "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), "block_score",
    )
