import numpy as np
from llm_cases import PAGES, documents, with_clashes

from photarium.llm import language

SAYS = {
    "en": "the house and the garden are with the other children where they were", "de": "das haus und der garten sind nicht weit von der schule und dem wald",
    "fr": "la maison et le jardin sont dans une rue qui est loin de la ville",
}


def train(spark):
    return documents(spark, [(i, f"{SAYS[lang]} {i}", lang, "a", 0) for i, lang in enumerate(list(SAYS) * 20)])


def page(text, declared=""):
    return f"<html{declared and f' lang={declared!r}'}><body><article><p>{text}</p></article></body></html>"


def identify(spark, rows):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], PAGES)
    got = {r["page_id"]: r for r in language.identify(pages, train(spark)).collect()}
    return [got[i] for i in range(len(rows))]


def test_text_beats_markup_and_priors_decide_the_rest(spark):
    rows = [(f"http://x{i}.de/{i}", page(SAYS["de"], "de")) for i in range(20)] + [(f"http://z.com/{i}", page(SAYS["fr"])) for i in range(20)]
    rows += [("http://new.de/", ""), ("http://z.com/n", None), ("http://q.org/", page("", "fr")), ("http://x1.de/e", page(SAYS["en"] * 3, "de"))]
    got = [r["lang"] for r in identify(spark, rows)]
    assert got == ["de"] * 20 + ["fr"] * 20 + ["de", "fr", "fr", "en"]


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "", ""), (2, "http://a.b/", page("x " * 50_000, "xx")), (3, "no host", page("é"))]
    pages = with_clashes(spark.createDataFrame(rows, PAGES), "lang", "score", "host", "extra")
    got = language.identify(pages, train(spark)).collect()
    assert len(got) == len(rows) and all(r["lang"] in SAYS and 0 <= r["score"] <= 1 for r in got)
    assert language.identify(spark.createDataFrame([], PAGES), train(spark)).count() == 0
    assert {r["lang"] for r in language.identify(pages, documents(spark, [])).collect()} == {None}


def test_declared_languages_of_the_given_pages(spark):
    from photarium.llm.registry import op4_language

    got = op4_language(spark, "/root/testdata/sf0.001").collect()
    assert sum(r["lang"] == r["declared"] for r in got) >= 0.95 * len(got)


def test_training_texts_are_counted_whole(spark):
    late = "x" * 30_000 + " zebra quagga"
    docs = spark.createDataFrame([(1, late, "en"), (2, "y" * 10, "de"), (3, "", "fr")], "doc_id long, text string, lang string")
    names, table = language.fit_table(docs)
    whole = language.fit([late, "y" * 10, ""], ["en", "de", "fr"])
    assert names == whole[0] == ["de", "en", "fr"] and np.allclose(table, whole[1])
    gram = language.gram_counts("quagga")[2]
    assert table[1, gram] > table[0, gram]
    assert set(language.labelled_sample(docs)["text"]) == {late, "y" * 10, ""}
