"""Given columns with the names that operators use for themselves."""

from collections import Counter

import pytest
from llm_cases import PAGES, documents, with_clashes

from photarium.llm import html, language, mixing, sharding, toxicity, urls

NAMES = (
    "_given", "_size", "_key", "_source", "_cut", "_row", "_copy", "_s", "_t", "_b", "_bucket", "_buckets", "_rest", "_mix", "_start", "_id_text",
    "_e", "_h", "_text", "_p0", "_best", "_at", "_n", "_rows", "_below", "_rule", "_host", "_blocks", "_page", "_run", "row", "found", "at",
)


def pages(spark):
    rows = [(1, "http://a.org/x", "<html lang='en'><p>The text of a page</p>"), (1, "http://a.org/x", "<p>The text of a page"), (None, None, None), (2, "u", "")]
    return with_clashes(spark.createDataFrame(rows, PAGES), *NAMES)


def kept(result, given):
    rows = result.collect()
    assert len(rows) == given.count()
    assert all(r[n] == f"clash of {n}" for r in rows for n in NAMES)
    assert Counter(str(r[given.columns[0]]) for r in rows) == Counter(str(r[0]) for r in given.collect())


@pytest.mark.parametrize("use", [
    mixing.mix, sharding.shuffle_into_shards, lambda docs: toxicity.score(docs, toxicity.Model()), lambda docs: toxicity.clean(docs, toxicity.Model()),
])
def test_documents(spark, use):
    docs = with_clashes(documents(spark), *NAMES)
    kept(use(docs), docs)


@pytest.mark.parametrize("use", [html.extract, urls.judge, lambda rows: language.identify(rows, documents(rows.sparkSession))])
def test_pages(spark, use):
    kept(use(pages(spark)), pages(spark))


def test_the_mix_itself(spark):
    docs = with_clashes(documents(spark), *NAMES, "size", "copies")
    rows = mixing.repeated(docs)
    assert rows.columns == docs.columns and {r["size"] for r in rows.collect()} == {"clash of size"}
