"""Main text of web pages, with suffix arrays over the pages of a host.

A page is cut into blocks of text. Markup decides what it can: menus, headers, footers,
sidebars, forms, scripts and elements named as adverts, notices or comments go, and on a page
that marks its article only that is kept. A name is no reason to drop an element that holds the
article or nearly all of the text around it, as layout classes on a page's frame do; nor are
names that tell what a page has or lacks. Tags that HTML lets a page omit are implied. What markup
leaves is checked against the host's other pages: runs of ``RUN`` tokens which stand on many
distinct pages of the whole host are boilerplate. Tokens covered by such a run are removed, unique
runs are kept.

Inside a marked article a run must stand on most pages of the host to be removed: articles
may quote or copy each other. Elsewhere a few pages are enough. Pages of a host with the same
blocks are one page in all counts.

Runs are known by 64-bit hashes of host and tokens, and counted in two ways. On pages without an
article all runs are counted. Within articles, a task sorts the suffixes of about ``GROUP_PAGES``
pages at a time; a run on a share of the host's pages has that share in some group, so the runs
that reach it in any group are all that can, and those are counted over the whole host.

Nulls and repeats: null or empty html has no text; pages without host are dealt like those of
one host; a page without text stays empty. Very long pages are cut like others. Of runs on equally
many pages all go or stay. Given columns may have any name; ``html`` goes, and ``text`` and
``n_chars`` are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photarium.llm.common import settle
from photarium.llm.urls import host_of

RUN = 8
# Pages, and about as many tokens, that a task sorts together; no result depends on them.
GROUP_PAGES, GROUP_TOKENS = 2_000, 1_000_000
# Size of the bitmap that keeps most runs out of a join; what it lets through is joined exactly.
FILTER_BITS = 24
# A run outside of articles is boilerplate on this many pages of a host, one inside on this share.
LEAST_PAGES = 3
ARTICLE_SHARE, ARTICLE_PAGES = 0.6, 10

# Element names of HTML by their role.
RAW = "script style noscript template textarea title iframe object svg math select".split()
CHROME = "nav header footer aside form head button dialog menu".split() + RAW
HEAD = "base link meta noscript script style template title".split()
VOID = "area base br col embed hr img input link meta source track wbr param".split()
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br input"
).split()
# What a start tag ends: these elements, if none of those stands between.
_CELL = ({"td", "th"}, {"tr", "table"})
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": _CELL, "th": _CELL,
    "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# Start tags that end an open paragraph.
BLOCKS = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split()
)
# Words in class, id or role that name what is not the article; readers' comments may be longer than it.
READERS = set("comment comments commentlist disqus replies respond".split())
NAMED = READERS | set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs masthead header footer sidebar aside widget related share sharing social newsletter subscribe subscription "
    "cookie cookies consent gdpr notice notices popup modal overlay search login signup "
    "copyright contentinfo complementary toolbar pagination pager skip alert disclaimer promoted".split()
)
# Beginnings of class names that say what a page has or lacks, not what the element is.
STATES = set("no not has have with without is js enable enabled disable disabled show hide".split())
# An element that holds this share of the text it stands in is no side matter, whatever its name; comments need more.
MOST, NEARLY_ALL = 0.8, 0.95
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>?", re.DOTALL
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTS = re.compile(r"[^a-z]+")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
# White space separates words.
_SPACE = re.compile(r"[\s\x00]+")
# What an element is: text, side matter by its tag, by its name, readers' comments, the article.
PLAIN, CHROMED, CALLED, READERS_SAY, ARTICLE = range(5)


def _kind(name: str, attributes: str) -> int:
    """What class, id, role and tag say that an element is."""
    kind = CHROMED if name in CHROME else ARTICLE if name in ("article", "main") else PLAIN
    if not attributes or name in ("html", "body"):
        return kind
    for which, *groups in _NAMES.findall(attributes):
        for word in "".join(groups).split():
            if which.lower() == "role" and word.lower() in ("main", "article"):
                return ARTICLE
            parts = _PARTS.split(_CAMEL.sub(" ", word).lower())
            if parts[0] in STATES and len(parts) > 1:
                continue
            if not READERS.isdisjoint(parts):
                return READERS_SAY
            if not NAMED.isdisjoint(parts) and kind != CHROMED:
                kind = CALLED
    return kind


class _Page:
    """Elements and pieces of text of a page, in order."""

    def __init__(self, html: str):
        self.names, self.parents, self.kinds = ["#page"], [0], [PLAIN]
        self.pieces: list[tuple[int, str | None]] = []  # element and text; None ends a block
        self.open = [0]
        at = 0
        while at < len(html):
            tag = _TOKEN.search(html, at)
            text = html[at:tag.start() if tag else len(html)]
            if text:
                self.pieces.append((self.open[-1], text))
            if not tag:
                break
            at, name = tag.end(), (tag.group(2) or "").lower()
            if not name:
                continue
            if name not in INLINE:
                self.pieces.append((0, None))
            elif name == "br":
                self.pieces.append((self.open[-1], " "))
            if tag.group(1):
                self._end(name)
                continue
            self._imply_ends(name)
            if name in VOID or tag.group(3).endswith("/"):
                continue
            if name in RAW:
                end = _RAW_END[name].search(html, at)
                at = end.end() if end else len(html)
                continue
            self.open.append(len(self.names))
            self.names.append(name)
            self.parents.append(self.open[-2])
            self.kinds.append(_kind(name, tag.group(3)))

    def _close(self, ended, across) -> None:
        """End the innermost of some elements and all inside it, if only such as ``across`` takes stand between."""
        for place in range(len(self.open) - 1, 0, -1):
            name = self.names[self.open[place]]
            if name in ended:
                del self.open[place:]
                return
            if not across(name):
                return

    def _end(self, name: str) -> None:
        if name in INLINE or name == "p":
            self._close((name,), INLINE.__contains__)
        elif name in ENDS:
            limits = ENDS[name][1]
            self._close((name,), lambda other: other not in limits)
        else:
            self._close((name,), lambda other: True)

    def _imply_ends(self, name: str) -> None:
        if name not in HEAD and self.names[self.open[-1]] == "head":
            self.open.pop()
        if name in BLOCKS:
            self._close(("p",), INLINE.__contains__)
        elif name in ENDS:
            ended, limits = ENDS[name]
            self._close(ended, lambda other: other not in limits)

    def shown(self) -> tuple[list[bool], list[int]]:
        """For each element whether its text is shown, and the number of the article it stands in (0: none)."""
        n = len(self.names)
        size = [0] * n
        for element, text in self.pieces:
            if text:
                size[element] += len(text.strip())
        held = [int(kind == ARTICLE) for kind in self.kinds]
        for element in range(n - 1, 0, -1):
            size[self.parents[element]] += size[element]
            held[self.parents[element]] += held[element]
        # Articles among readers' comments are comments, if there is another.
        among = [False] * n
        for element in range(1, n):
            above = self.parents[element]
            among[element] = among[above] or self.kinds[element] == READERS_SAY
        real = sum(kind == ARTICLE and not a for kind, a in zip(self.kinds, among))
        shown, number, within, articles = [True] * n, [0] * n, [0] * n, 0
        for element in range(1, n):
            above, kind, name = self.parents[element], self.kinds[element], self.names[element]
            whole = size[within[above]]
            if kind == READERS_SAY:
                hides = real > 0 if held[element] else size[element] < NEARLY_ALL * whole or bool(number[above])
            elif kind == CALLED:
                hides = not held[element] and size[element] < MOST * whole
            elif kind == CHROMED:
                hides = name == "head" or not held[element] and not (name == "form" and size[element] >= MOST * whole)
            else:
                hides = False
            shown[element] = shown[above] and not hides
            number[element], within[element] = number[above], within[above]
            begins = kind == ARTICLE or name == "article"
            if begins and shown[element]:
                if not number[above]:
                    articles += 1
                    number[element] = articles
                within[element] = element
        return shown, number


def blocks(html: str | None) -> list[tuple[str, int]]:
    """The text blocks that markup leaves, each with the number of its marked article, from 1; 0 is outside."""
    if not html:
        return []
    page = _Page(html)
    shown, number = page.shown()
    out: list[tuple[str, int]] = []
    text: list[str] = []
    article = 0
    for element, piece in [*page.pieces, (0, None)]:
        if piece is not None:
            if shown[element]:
                text.append(piece)
                article = article or number[element]
            continue
        if text:
            block = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if block:
                out.append((block, article))
            text.clear()
        article = 0
    return [b for b in out if b[1]] if any(b[1] for b in out) else out


def repeats(streams: list[np.ndarray], pages: list[int], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """For the token streams laid end to end: on how many distinct pages the run from each token on
    stands (0 if the stream ends before), and the tokens left of each stream.

    ``streams`` hold token numbers, ``pages`` the number of each stream's page. Suffixes are
    ranked by their first 1, 2, 4, ... tokens until runs of ``run`` tokens are told apart;
    equal ranks are one interval of the suffix array.
    """
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    tokens = np.concatenate([s for s in streams if len(s)]).astype(np.int64)
    page = np.repeat(np.array(pages, dtype=np.int64), lengths)
    stop = np.repeat(np.cumsum(lengths), lengths)
    room = stop - np.arange(total)
    rank, width = tokens, 1
    while width < run:
        step = min(width, run - width)
        follows = np.minimum(np.arange(total) + step, total - 1)
        pair = rank * (total + int(tokens.max()) + 2) + np.where(room > step, rank[follows] + 1, 0)
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width += step
    full = room >= run
    many = int(page.max()) + 1
    place = np.unique(rank[full] * many + page[full]) // many
    counts = np.bincount(place, minlength=int(rank.max()) + 1)
    return np.where(full, counts[rank], 0), room


def repeated(streams: list[np.ndarray], pages: list[int], run: int = RUN) -> list[np.ndarray]:
    """For each token stream, on how many distinct pages the best run over each token stands."""
    starts, room = repeats(streams, pages, run)
    best = starts.copy()  # the best of the runs that begin at most run - 1 tokens before
    for back in range(1, run):
        best[back:] = np.maximum(best[back:], np.where(room[:-back] > back, starts[:-back], 0))
    return np.split(best, np.cumsum([len(s) for s in streams])[:-1])


def unique_runs(words: list[str], covered: np.ndarray) -> str:
    """A block without its covered stretches. A short stretch goes only with the whole block: it is the
    end of a run that stands in the blocks around."""
    gone = covered.copy()
    if not covered.all():
        edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
        for start, stop in edges.reshape(-1, 2):
            if stop - start < RUN:
                gone[start:stop] = False
    return " ".join(w for w, out in zip(words, gone) if not out)


def run_hashes(words: list[str], host: int) -> np.ndarray:
    """A hash of the host and the run for each token with a whole run from it on."""
    n = len(words) - RUN + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    own = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    total = np.full(n, host, dtype=np.int64).view(np.uint64)
    for i in range(RUN):
        total = (total ^ own[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
    return total.view(np.int64)


def _words(found) -> list[str]:
    return [w for b in found for w in b["text"].split(" ")]


def _bits(runs: DataFrame) -> bytes:
    """A bitmap over the runs' last ``FILTER_BITS`` bits."""
    slot = F.pmod("_run", F.lit(1 << FILTER_BITS))
    parts = runs.groupBy(F.floor(slot / 32_768).alias("part")).agg(F.bitmap_construct_agg(F.pmod(slot, F.lit(32_768))).alias("bits")).collect()
    whole = bytearray(1 << FILTER_BITS - 3)
    for r in parts:
        whole[r["part"] * 4_096:(r["part"] + 1) * 4_096] = r["bits"]
    return bytes(whole)


def _runs(within: bytes | None = None):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The distinct runs of each page; those that ``within`` rules out are left out."""
        bits = None if within is None else np.frombuffer(within, dtype=np.uint8)

        def runs_of(blocks_of, host: int) -> np.ndarray:
            runs = run_hashes(_words(blocks_of), host)
            if bits is not None:
                slot = runs & ((1 << FILTER_BITS) - 1)
                runs = runs[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
            return np.unique(runs)

        for pdf in batches:
            for start in range(0, len(pdf), 500):
                part = pdf.iloc[start:start + 500]
                runs = [runs_of(b, h) for b, h in zip(part["_blocks"], part["_host"])]
                n = [len(r) for r in runs]
                yield pd.DataFrame({
                    "_host": np.repeat(part["_host"].to_numpy(), n), "_page": np.repeat(part["_page"].to_numpy(), n), "_run": np.concatenate(runs)
                })

    return found


def _candidates(group_pages: int):
    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs that may stand on ``_often`` of the ``_rows`` pages of a host: those on that share of a group's."""
        waiting: dict[tuple[int, int, int], list[list[str]]] = {}
        pages = size = 0

        def found() -> pd.DataFrame:
            runs = [np.zeros(0, dtype=np.int64)]
            for (host, often, rows), texts in waiting.items():
                number: dict[str, int] = {}
                streams = [np.array([number.setdefault(w, len(number)) for w in t], dtype=np.int64) for t in texts]
                starts, _ = repeats(streams, list(range(len(streams))))
                reached = np.split(starts >= max(1, -(-len(texts) * often // rows)), np.cumsum([len(t) for t in texts])[:-1])
                own = [run_hashes(t, host)[r[:len(t) - RUN + 1]] for t, r in zip(texts, reached) if r.any()]
                if own:
                    runs.append(np.unique(np.concatenate(own)))
            return pd.DataFrame({"_run": np.concatenate(runs)})

        for pdf in batches:
            for blocks_of, *key in zip(pdf["_blocks"], pdf["_host"], pdf["_often"], pdf["_rows"]):
                words = _words(blocks_of)
                if len(words) >= RUN:
                    waiting.setdefault(tuple(int(k) for k in key), []).append(words)
                pages, size = pages + 1, size + len(words)
                if pages >= group_pages or size >= GROUP_TOKENS:
                    yield found()
                    waiting.clear()
                    pages = size = 0
        yield found()

    return candidates


def main_text(found, host: int, inside: np.ndarray, outside: np.ndarray) -> str:
    """A page's text without the given runs of articles and of other pages. An article that is covered whole stays."""
    split = [b["text"].split(" ") for b in found]
    numbers = [b["article"] for b in found]
    words = [w for block in split for w in block]
    gone = inside if any(numbers) else outside
    if not len(gone) or len(words) < RUN:
        return "\n\n".join(b["text"] for b in found)
    covered = np.zeros(len(words), dtype=bool)
    starts = np.isin(run_hashes(words, host), gone)
    for i in range(RUN):
        covered[i:i + len(starts)] |= starts
    number = np.repeat(numbers, [len(b) for b in split])
    for article in set(numbers) - {0}:
        if covered[number == article].all():
            covered[number == article] = False
    parts = np.split(covered, np.cumsum([len(b) for b in split])[:-1])
    return "\n\n".join(t for t in map(unique_runs, split, parts) if t)


def extract(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars``."""
    added = {"text", "n_chars", "html"}
    given = [c for c in pages.columns if c not in added]

    @F.pandas_udf("array<struct<text:string,article:int>>")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([[{"text": t, "article": a} for t, a in blocks(h)] for h in series])

    row = F.struct(*(F.col(f"`{c}`") for c in given)).alias("_given")
    rows = settle(pages.select(row, F.xxhash64(host_of(F.col("url"))).alias("_host"), parsed("html").alias("_blocks")), "html-blocks")
    rows = rows.withColumn("_page", F.xxhash64("_host", "_blocks"))
    texts = rows.select("_host", "_page", "_blocks")
    marked = F.exists("_blocks", lambda b: b["article"] > 0)
    pair = "_host long, _page long, _run long"

    # Hosts with pages enough for a run to be frequent in articles.
    often = F.greatest(F.lit(ARTICLE_PAGES), F.ceil(F.col("_pages") * ARTICLE_SHARE)).cast("bigint")
    hosts = settle(
        texts.groupBy("_host", "_page").agg(F.count(F.lit(1)).alias("n")).groupBy("_host")
        .agg(F.count(F.lit(1)).alias("_pages"), F.sum("n").alias("_rows")).withColumn("_often", often).filter(F.col("_pages") >= F.col("_often")),
        "html-hosts",
    )
    possible = settle(texts.join(hosts, "_host").select("_host", "_often", "_rows", "_blocks").mapInPandas(_candidates(group_pages), "_run long").distinct(), "html-candidates")
    counted = texts.join(hosts, "_host", "left_semi").mapInPandas(_runs(_bits(possible)), pair).join(possible, "_run", "left_semi").distinct()
    frequent = counted.groupBy("_host", "_run").count().join(hosts, "_host").filter(F.col("count") >= F.col("_often"))
    # Each page has at most so many runs, so a host has few that stand on most of its pages.
    inside = settle(frequent.groupBy("_host").agg(F.collect_list("_run").alias("_inside")), "html-inside")

    # Pages without an article: every run on them, wherever else on the host it stands.
    plain = settle(texts.filter((F.size("_blocks") > 0) & ~marked).mapInPandas(_runs(), pair).distinct(), "html-outside")
    joined = rows.join(inside, "_host", "left")
    if plain.isEmpty():
        joined = joined.withColumn("_outside", F.lit(None).cast("array<bigint>"))
    else:
        quoted = texts.filter(marked).mapInPandas(_runs(_bits(plain)), pair).join(plain.select("_run").distinct(), "_run", "left_semi").distinct()
        repeated_runs = plain.unionByName(quoted).groupBy("_run").count().filter(F.col("count") >= LEAST_PAGES).select("_run")
        outside = plain.join(repeated_runs, "_run").groupBy("_page").agg(F.collect_list("_run").alias("_outside"))
        joined = joined.join(outside, "_page", "left")

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        none = np.zeros(0, dtype=np.int64)
        for found in batches:
            yield pd.Series([main_text(b, h, *(none if r is None else np.asarray(r) for r in runs)) for b, h, *runs in zip(*found)], dtype=object)

    out = joined.select("_given", cleaned("_blocks", "_host", "_inside", "_outside").alias("text"))
    return out.select(*(F.col(f"_given.`{c}`") for c in given), "text", F.char_length("text").cast("bigint").alias("n_chars"))
