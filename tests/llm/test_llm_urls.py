import re

import pandas as pd
from llm_cases import PAGES, lower, with_clashes

from photarium.llm import urls

URLS = [
    "http://a.org/x", "http://a.org", "http://example.org/es/1", "http://m.example.org/en/12", "http://notexample.org/es/1",
    "https://WWW.Shop.COM/fr/1?x=/de/", "http://shop.com/de/9#y", "http://shop.com/en/9", "ftp://host.net/a?b", "no scheme", "",
    None, "x://A.ORG?q", "a://b://c.org/", "http://shop.com:80/fr/", "http://shop.com\n/fr/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^?#]*", rest[len(host):]).group()
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def pages(spark, found):
    return spark.createDataFrame([(i, u, "") for i, u in enumerate(found)], PAGES)


def test_hosts_paths_and_rules(spark):
    model = urls.UrlModel(weights=__import__("numpy").zeros(urls.FEATURES), bias=3.0)
    for r in urls.judge(pages(spark, URLS), model=model).collect():
        host, path, (rule, verdict) = brute(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or "block")


def test_the_classifier_learns(spark):
    rows = [(f"h{i % 7}.net", f"/{'spam' if i % 2 else 'news'}/{i}", i % 2) for i in range(200)]
    model = urls.fit(pd.DataFrame(rows, columns=["host", "path", "blocked"]))
    assert model.score("other.net", "/spam/999") > 0.5 > model.score("other.net", "/news/998")


def test_sample_is_bounded_and_from_the_rules(spark):
    many = pages(spark, [f"http://a{i}.org/{i}" for i in range(50)] + [f"http://b.com/de/{i}" for i in range(50)])
    sample = urls.labelled_urls(many, most=30)
    assert len(sample) == 30 and set(sample["blocked"]) == {0, 1}
    got = urls.judge(pages(spark, [f"http://a{i}.org/en/{i}" for i in range(40)] + [f"http://b.com/de/{i}" for i in range(40)] + ["http://z.net/de/3"]))
    assert got.filter("page_id = 80").first()["verdict"] == "block"


def test_odd_rows(spark):
    docs = with_clashes(pages(spark, URLS + URLS[:3]), "host", "verdict", "rule", "extra")
    assert urls.judge(docs).count() == len(URLS) + 3
    assert urls.judge(pages(spark, [])).count() == 0
    assert {r["verdict"] for r in urls.judge(pages(spark, [None, "x"])).collect()} == {"allow"}
