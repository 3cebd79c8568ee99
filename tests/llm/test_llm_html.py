import numpy as np
import pytest
from llm_cases import PAGES, with_clashes

from photarium.llm import html

ARTICLE = "<article><h1>Title &amp; more</h1><p>First  <b>bold</b>\n line.<br>Next.<p>Second &#233;t&eacute;.</article>"


def texts(spark, found, **options):
    rows = [(i, u, h) for i, (u, h) in enumerate(found)]
    got = html.extract(spark.createDataFrame(rows, PAGES), **options).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_markup_decides_on_pages_with_an_article(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>"
        f"<a href='/a'>Menu</a></ul></nav><!-- ad --><div class='ad'>Buy</div><header>Top</header>{ARTICLE}"
        "<aside>Side</aside><form><label>Mail</label></form><section id='comments'>I say</section><footer>&copy; x</footer>"
    )
    inner = ARTICLE.replace("<p>Second", "<div class=\"x cookieNotice\">Cookies!</div><script>1</script><aside>s</aside><p>Second")
    expected = "Title & more\n\nFirst bold line. Next.\n\nSecond été."
    assert texts(spark, [("http://a.org/1", page), ("http://a.org/2", inner), ("http://a.org/3", "<nav>never closed" + ARTICLE)]) == [expected] * 3


def test_suffix_arrays_decide_on_pages_without_one(spark):
    menu = "Home Products News About us Contact Imprint Jobs Press Shop"
    pages = [(f"http://h.org/{i}", f"<div>{menu}</div><div>Text number {i} is about thing {i * 7} only</div>") for i in range(6)]
    got = texts(spark, pages)
    assert got == [f"Text number {i} is about thing {i * 7} only" for i in range(6)]
    # On two pages only it is no boilerplate, nor on other hosts.
    assert menu in texts(spark, pages[:2])[0]
    assert menu in texts(spark, [(f"http://h{i}.org/", h) for i, (_, h) in enumerate(pages)])[0]


def test_articles_may_be_copies(spark):
    copy = "<article><p>" + " ".join(f"w{i}" for i in range(80)) + "</p></article>"
    pages = [(f"http://h.org/{i}", copy if i % 2 else f"<article><p>{' '.join(f'v{i}_{j}' for j in range(80))}</p></article>") for i in range(24)]
    assert texts(spark, pages)[1] == " ".join(f"w{i}" for i in range(80))
    notice = "This site uses cookies to make your visit better than ever before"
    pages = [(f"http://h.org/{i}", f"<article><p>{notice}</p><p>own{i} text{i} here{i}</p></article>") for i in range(24)]
    assert texts(spark, pages) == [f"own{i} text{i} here{i}" for i in range(24)]


def test_repeated_runs_against_brute_force():
    rng = np.random.default_rng(5)
    streams = [rng.integers(0, 3, rng.integers(0, 60)) for _ in range(20)]
    pages = [i // 2 for i in range(20)]
    seen = {}
    for s, p in zip(streams, pages):
        for i in range(len(s) - 3):
            seen.setdefault(tuple(s[i:i + 4]), set()).add(p)
    for s, best in zip(streams, html.repeated(streams, pages, run=4)):
        expected = [max((len(seen[tuple(s[i:i + 4])]) for i in range(max(0, t - 3), min(t + 1, len(s) - 3))), default=0) for t in range(len(s))]
        assert list(best) == expected


def test_groups_of_a_hot_host(spark):
    pages = [(f"http://h.org/{i}", f"<div>{' '.join(f'm{j}' for j in range(10))}</div><p>page {i}</p>") for i in range(60)]
    assert texts(spark, pages, group_pages=20) == [f"page {i}" for i in range(60)]


def test_few_pages_of_a_hot_host(spark):
    block = " ".join(f"m{j}" for j in range(10))
    pages = [(f"http://h.org/{i}", f"<p>page {i} of {i * 7}</p>" + f"<div>{block}</div>" * (i in (3, 28, 55))) for i in range(60)]
    assert texts(spark, pages, group_pages=3) == [f"page {i} of {i * 7}" for i in range(60)]
    pages[28] = ("http://h.org/28", f"<article>{block}</article>")
    assert texts(spark, pages, group_pages=3)[3] == "page 3 of 21" and texts(spark, pages, group_pages=3)[28] == block
    # A run on 12 of 20 articles, spread over the groups.
    pages = [(f"http://a.org/{i}", f"<article><p>own{i} text</p>{f'<p>{block}</p>' * (i % 5 < 3)}</article>") for i in range(20)]
    assert texts(spark, pages, group_pages=3) == [f"own{i} text" for i in range(20)]


def test_copies_of_an_article_count_once(spark):
    copy = " ".join(f"w{i}" for i in range(80))
    pages = [(f"http://h.org/{i}", f"<article>{copy if i < 10 else f'other{i} text'}</article>") for i in range(12)]
    assert texts(spark, pages) == [copy] * 10 + ["other10 text", "other11 text"]
    # An article of nothing but runs that other articles have stays; so does a page of which there are copies.
    pages = [(f"http://h.org/{i}", f"<article>{copy}{f' end{i}' * (i > 0)}</article>") for i in range(12)]
    assert texts(spark, pages)[0] == copy
    assert texts(spark, [(f"http://h.org/{i}", f"<p>{copy}</p>") for i in range(4)]) == [copy] * 4


def test_odd_rows(spark):
    rows = [
        (1, None, None), (2, "http://a.org/", ""), (None, None, "<p>no id</p>"), (3, "x", "plain & text &lt;b&gt; 1 < 2"), (3, "x", "plain"), (3, "x", "plain"),
        (4, "http://a.org/l", "<p>" + "word " * 50_000), (5, "http://a.org/q", "<p title=\"it's>a\">quote</p><a href='x"), (6, "u", "<script>open"),
        (7, "u", "<!-- open"), (8, "u", "<p>a<p/>b</p></p></div>c"), (9, "u", "&#0;&#xD800;&nosuch;"),
    ]
    pages = with_clashes(spark.createDataFrame(rows, PAGES), "text", "n_chars", "extra")
    got = html.extract(pages).collect()
    assert len(got) == len(rows) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[2] == by_id[1] == by_id[6] == by_id[7] == "" and by_id[5].startswith("quote") and by_id[8] == "a\n\nb\n\nc"
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


REAL = "Real article text with quite a number of words in it."


@pytest.mark.parametrize("page", [
    "<body><div class='layout sidebar-left'><div id='sidebar'>Side menu</div><article>{}</article></div>",
    "<body><div class='site header-fixed'><div class='header'>Top</div><article>{}</article></div>",
    "<body><div class='layout sidebar-left'><p>{}</p></div>", "<body class='has-sidebar comments-open'><p>{}</p>",
    "<body><div class='content no-sidebar'><p>{}</p></div><div class='sidebar'>Side</div>",
    "<html><head><title>T</title><meta name=x><body><p>{}</p></body>", "<head><title>T</title><article>{}</article>",
    "<html><head><title>T</title><style>p{{}}</style><div><article>{}</article></div>",
    "<body><form action='/'><div><p>{}</p></div></form>", "<form><div><article>{}</article></div><input></form>",
    "<main><p class='ad'>Buy<p>{}", "<!--><p>{}</p>", "<!---><p>{}</p>", "<!-- x --!><p>{}</p><!-- open",
    "<article>{}</article><article class='comment-body'>I say so</article>", "<article class='related'>More of this</article><article>{}</article>",
    "<article>{}</article><section id='comments'><article>One reader</article><article>Another reader says far more than the article itself says in all "
    "of its words, and goes on and on and on about it</article></section>",
    "<article>{}<div class='comments'>A reader says far more than the article itself does in all of its words, and goes on and on</div></article>",
    "<nav>never closed<article>{}</article>", "<div role='main'>{}</div><div>elsewhere</div>", "<header><nav>Menu</nav></header><main>{}</main><footer>F</footer>",
    "<ul class='nav'><li>A<li>B</ul><div>{}</div>", "<table><tr><td class='menu'>Menu<td>{}</table>", "<dl><dt class='ad'>Buy<dd>{}</dl>",
    "<p>{}</p><div class='ad'>Buy</div><div class='x newsletter-signup'>Mail</div><div id='cookieNotice'>Cookies</div><aside>A</aside>",
    "<article class='post no-comments'>{}</article>", "<div class='post-wrapper'><span class='ad'>Ad</span>{}</div>",
])
def test_markup_of_many_kinds(page):
    assert html.blocks(page.format(REAL)) == [(REAL, html.blocks(page.format(REAL))[0][1])]


def test_several_paragraphs_and_implied_ends():
    page = "<main><p class='ad'>Buy<p>Real <b>one.<p>Real</b> two.<ul><li>a<li class=promo>b<li>c</ul><p>End</main>"
    assert [t for t, _ in html.blocks(page)] == ["Real one.", "Real two.", "a", "c", "End"]
    assert [t for t, _ in html.blocks("<p>1 <i>x<div>2</i></div></p>3")] == ["1 x", "2", "3"]


def plain_runs(pages, least):
    """Runs of eight words on at least so many distinct pages, by brute force."""
    seen = {}
    for text in set(pages):
        words = text.split()
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i:i + 8]), set()).add(text)
    return {run for run, on in seen.items() if len(on) >= least}


def test_extraction_without_articles_against_brute_force(spark):
    """What the runs take away is what a plain search for repeated runs takes away; markup alone keeps it all."""
    rng = np.random.default_rng(11)
    common = [" ".join(f"c{k}w{j}" for j in range(8 + k)) for k in range(4)]
    pages = []
    for i in range(30):
        parts = [" ".join(f"p{i}_{j}_{k}" for k in range(rng.integers(1, 12))) for j in range(4)]
        for k, text in enumerate(common):
            if rng.random() < (0.05, 0.1, 0.3, 0.9)[k]:
                parts.insert(int(rng.integers(0, len(parts) + 1)), text)
        pages.append(parts)
    gone = plain_runs([" ".join(p) for p in pages], html.LEAST_PAGES)
    expected, alone = [], []
    for parts in pages:
        words = " ".join(parts).split()
        covered = [False] * len(words)
        for i in range(len(words) - 7):
            if tuple(words[i:i + 8]) in gone:
                covered[i:i + 8] = [True] * 8
        at, kept = 0, []
        for part in parts:
            own = part.split()
            if not all(covered[at:at + len(own)]):
                kept.append(part)
            at += len(own)
        expected.append("\n\n".join(kept))
        alone.append("\n\n".join(parts))
    got = texts(spark, [(f"http://b.org/{i}", "".join(f"<p>{t}</p>" for t in parts)) for i, parts in enumerate(pages)])
    assert got == expected and got != alone


def test_clashing_columns_of_all_steps(spark):
    names = ["_host", "_blocks", "_page", "_run", "_given", "_inside", "_outside", "_pages", "_often", "_rows", "text"]
    pages = with_clashes(spark.createDataFrame([(1, "http://a.org/", f"<p>{REAL}</p>")], PAGES), *names)
    row = html.extract(pages).first()
    assert row["text"] == REAL and all(row[n] == f"clash of {n}" for n in names[:-1])
