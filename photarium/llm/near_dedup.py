"""Near-duplicate documents: an inverted join on the coordinates of MinHash signatures.

1. Each text becomes the set of its 5-word shingles; texts with equal sets are one class, so
   exact copies cost nothing further. A class has a signature of ``COORDINATES`` minima.
2. Classes are posted under (coordinate, value) pairs. Two sets with a Jaccard index of 0.85
   agree on 54 of 64 coordinates on average, and on fewer than ``MATCHES`` (36) in one of 10^7
   cases. Sets that agree on so many share one of the first 64 - 36 + 1 pairs of either, in any
   fixed order of all pairs: only this prefix is posted. The order puts frequent pairs last, so
   what many documents share is skipped wherever a document has enough else.
3. A posting list is one cell. In it collisions are counted pair by pair, and a pair of classes
   belongs to the list of its first common pair only, so it is looked at once. Lists longer than
   ``CELL`` are split into blocks, and each two blocks make a cell.
4. What agrees often enough is confirmed on the full sets. Inside a cell, pairs that are already
   connected by confirmed links are skipped: a cell returns at most one link per member, never
   all pairs of a group.
5. Components of the links by rounds of smallest neighbours, each round a table.

The signature decides only which pairs are confirmed; links are exact. The chance to miss a
link is that of step 2, and only for links at the very threshold.

Nulls and repeats: null or empty texts are linked with nothing and are their own component; rows
with the same text are linked whatever their ids; a null id is never the smallest id of a
component unless all ids are null. Rows that share id and component are all kept or none;
``keep_one`` leaves one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from photarium.llm.common import WORD, settle, slices

SHINGLE = 5
LEAST_PERCENT = 85
COORDINATES = 64
MATCHES = 36
PREFIX = COORDINATES - MATCHES + 1
# Members of a cell; longer posting lists are split.
CELL = 2_048
# Cells of up to so many members are compared together, so many pairs at a time.
SMALL_CELL, PAIR_ROWS = 32, 200_000
# What tells cells apart: the pair of coordinate and value, and the two blocks.
KEYS = ["pair", "a", "b"]
# A pair of coordinate and value is frequent from this many classes, and from this share of them.
FREQUENT_ROWS, FREQUENT_SHARE = 32, 1 / 2_000

_MULTIPLY = np.random.default_rng(2024).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(2025).integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text in UTF-8."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = pd.util.hash_array(np.array(words, dtype=object), categorize=len(words) > 1_000)
    if len(words) < SHINGLE:
        parts = _mix(hashed * _PLACES[:len(words)])
        return np.array([_mix(parts.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))[0]], dtype=np.uint64)
    total = np.zeros(len(words) - SHINGLE + 1, dtype=np.uint64)
    for i in range(SHINGLE):
        total += _mix(hashed[i:i + len(total)] * _PLACES[i])
    return np.unique(_mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of ``COORDINATES`` hash functions, cut to 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 2_048):
        block = shingles[start:start + 2_048]
        np.minimum(least, (block[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(1), out=least)
    return (_mix(least) >> np.uint64(32)).astype(np.uint32)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: size and digest of the shingle set (null if it is empty), and its signature."""
    for batch in slices(batches):
        sets = [shingle_set(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("_row"), batch.column("_key"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
            pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
        ], names=["_row", "_key", "n_shingles", "class", "signature"])


def _frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of coordinate and value that several rows of a batch share, with their number."""
    for pdf in batches:
        own = np.frombuffer(b"".join(pdf["signature"]), dtype=np.uint32).reshape(-1, COORDINATES)
        pairs, counts = np.unique(own.astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32), return_counts=True)
        yield pd.DataFrame({"pair": pairs[counts > 1], "rows": counts[counts > 1].astype(np.int64)})


def _order(own: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of each coordinate's pair in the fixed order of all pairs: rarely seen first."""
    codes = own.astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)
    at = np.minimum(np.searchsorted(pairs, codes), max(0, len(pairs) - 1))
    seen = np.where(pairs[at] == codes, counts[at], 0) if len(pairs) else np.zeros(codes.shape, dtype=np.int64)
    return np.log2(seen + 1).astype(np.int64) * COORDINATES + np.arange(COORDINATES)


def _postings(pairs: np.ndarray, counts: np.ndarray):
    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per class and prefix pair."""
        for pdf in batches:
            if pdf.empty:
                continue
            own = np.frombuffer(b"".join(pdf["signature"]), dtype=np.uint32).reshape(-1, COORDINATES)
            order = _order(own, pairs, counts)
            first = np.argsort(order, axis=1)[:, :PREFIX]
            code = np.take_along_axis(own, first, 1).astype(np.int64) | (first.astype(np.int64) << 32)
            yield pd.DataFrame({
                "pair": code.ravel(), "class": np.repeat(pdf["class"].to_numpy(), PREFIX),
            })

    return post


class Cells:
    """Whole cells, one after the other: members of posting lists, or of two blocks of one, with their signatures."""

    def __init__(self, table: pa.Table, pairs: np.ndarray, counts: np.ndarray):
        keys = [table.column(k).to_numpy() for k in KEYS]
        own = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
        order = _order(own, pairs, counts)
        self.own, self.sides, self.split = own, table.column("side").to_numpy(), keys[1] != keys[2]
        # Which of a member's pairs come before the one that its cell is the list of.
        self.earlier = order < np.take_along_axis(order, (keys[0] >> 32)[:, None], 1)
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        self.starts = np.concatenate(([0], change, [len(own)]))

    def _agree(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows in one cell: which belong there and agree often enough, and how often."""
        same = self.own[i] == self.own[j]
        agree = same.sum(1)
        fits = (agree >= MATCHES) & ~(same & self.earlier[i]).any(1)
        # Pairs within one of two blocks have a cell of their own.
        return fits & ~(self.split[i] & (self.sides[i] == self.sides[j])), agree

    def partners(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of rows that are to be confirmed: earlier row, later row, how often they agree."""
        sizes = np.repeat(np.diff(self.starts), np.diff(self.starts))
        left = np.repeat(self.starts[1:], np.diff(self.starts)) - np.arange(len(self.own)) - 1
        found = []
        small = np.flatnonzero(sizes <= SMALL_CELL)
        for step in range(1, SMALL_CELL):  # rows that many places apart, of all small cells at once
            i = small[left[small] >= step]
            for part in np.array_split(i, len(i) // PAIR_ROWS + 1):
                fits, agree = self._agree(part, part + step)
                found.append((part[fits], part[fits] + step, agree[fits]))
        for i in np.flatnonzero((sizes > SMALL_CELL) & (left > 0)):
            j = np.arange(i + 1, i + 1 + left[i])
            fits, agree = self._agree(np.full(len(j), i), j)
            found.append((np.full(fits.sum(), i), j[fits], agree[fits]))
        return tuple(np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3))


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells from batches sorted by cell; the last cell waits for its end."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in KEYS]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        last = waiting[-1] if waiting else None
        follows = last is not None and all(last.column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in KEYS)
        if follows and not len(change):
            waiting.append(batch)
            continue
        end = int(change[-1]) if len(change) else 0
        done = [*waiting, *([batch.slice(0, end)] if end else [])]
        if done:
            yield pa.Table.from_batches(done)
        waiting = [batch.slice(end)]
    if waiting:
        yield pa.Table.from_batches(waiting)


def _candidates(pairs: np.ndarray, counts: np.ndarray):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of cells with a partner that has to be confirmed there."""
        for table in whole_cells(batches):
            used = np.zeros(table.num_rows, dtype=bool)
            for rows in Cells(table, pairs, counts).partners()[:2]:
                used[rows] = True
            yield from table.filter(pa.array(used)).to_batches()

    return candidates


def jaccard_linked(x: np.ndarray, y: np.ndarray, percent: int = LEAST_PERCENT) -> bool:
    """Whether 100 x intersection >= percent x union, for sorted sets."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: np.ndarray, counts: np.ndarray):
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of cells, confirmed on the full sets: forests that connect what the links connect."""
        for table in whole_cells(batches):
            left, right, agree = Cells(table, pairs, counts).partners()
            names, sets = table.column("class").to_pylist(), table.column("shingles")
            group, chosen = list(range(table.num_rows)), []

            def find(i: int, group=group) -> int:
                while group[i] != i:
                    group[i] = i = group[group[i]]
                return i

            for at in np.argsort(-agree, kind="stable"):  # the likeliest first; a pair of rows is in one cell
                i, j = int(left[at]), int(right[at])
                a, b = find(i), find(j)
                if a != b and jaccard_linked(*(np.frombuffer(sets[k].as_buffer(), dtype=np.uint64) for k in (i, j))):
                    group[b] = a
                    chosen.append((names[i], names[j]))
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in chosen], pa.binary()) for k in (0, 1)], names=["x", "y"])

    return confirmed


@F.pandas_udf(BinaryType())
def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set((t or "").encode()).tobytes() for t in texts])


def by_cell(rows: DataFrame) -> DataFrame:
    """Rows dealt out and sorted so that cells are whole and follow each other."""
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS)


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links (x, y) between classes: in every group of linked classes enough to connect it."""
    signed = classes.select("class", "signature")
    total = classes.count()
    seen = signed.select("signature").mapInPandas(_frequent, "pair long, rows long").groupBy("pair").agg(F.sum("rows").alias("rows"))
    # At most COORDINATES / FREQUENT_SHARE pairs reach that share of all classes.
    often = seen.filter(F.col("rows") >= max(FREQUENT_ROWS, total * FREQUENT_SHARE)).orderBy("pair").toPandas()
    pairs, counts = often["pair"].to_numpy(np.int64), often["rows"].to_numpy(np.int64)

    posted = settle(signed.mapInPandas(_postings(pairs, counts), "pair long, class binary"), "dedup-postings")
    lists = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    lists = settle(lists.select("pair", F.ceil(F.col("_n") / CELL).cast("int").alias("blocks")), "dedup-lists")
    shared = posted.join(lists, "pair").join(signed, "class")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("side")).alias("a"), F.greatest(o, F.col("side")).alias("b")),
    )
    cells = shared.withColumn("side", block).select("pair", "class", "signature", "side", F.explode(others).alias("_c")).select(
        "pair", F.col("_c.a").alias("a"), F.col("_c.b").alias("b"), "side", "class", "signature"
    )
    likely = settle(by_cell(cells).mapInArrow(_candidates(pairs, counts), cells.schema), "dedup-likely")

    # Full sets of the classes that have a likely partner, from the text of one of their rows.
    wanted = likely.select("class").distinct().join(classes.select("class", "_id", "_key"), "class")
    own = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_k"), "text").join(
        wanted, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key"))
    )
    full = settle(own.dropDuplicates(["_d", "_k"]).select("class", _shingles("text").alias("shingles")), "dedup-sets")
    filled = by_cell(likely.join(full, "class").select(*likely.columns, "shingles"))
    return filled.mapInArrow(_confirmed(pairs, counts), "x binary, y binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """For every class in ``edges`` (x, y) the smallest class (``root``) that it is connected with.

    Each round links every class to the smallest one known to it, and that one's neighbours to
    it as well, until nothing changes; the distance covered about doubles each time.
    """
    edges = settle(edges.union(edges.select("y", "x")).distinct(), "dedup-edges")
    known = settle(edges.groupBy(F.col("x").alias("class")).agg(F.least(F.min("x"), F.min("y")).alias("root")), "dedup-roots")
    while True:
        # The smallest root among the neighbours', then the root of that root.
        near = edges.join(known, F.col("y") == F.col("class")).groupBy("x").agg(F.min("root").alias("near"))
        lower = known.join(near, F.col("x") == F.col("class")).select("class", F.col("root").alias("was"), F.least("root", "near").alias("low"))
        hooks = lower.groupBy(F.col("was").alias("h")).agg(F.min("low").alias("hook"))
        hooked = lower.join(hooks, F.col("was") == F.col("h")).select("class", "was", F.least("low", "hook").alias("low"))
        above = hooked.select(F.col("class").alias("u"), F.col("low").alias("up"))
        fresh = settle(hooked.join(above, F.col("low") == F.col("u")).select("class", "was", F.least("low", "up").alias("root")), "dedup-roots")
        changed = fresh.filter(F.col("was") != F.col("root")).limit(1).count()
        known = fresh.select("class", "root")
        if not changed:
            return known


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``text_key`` (a hash of the text), ``n_shingles``, ``component_id``, ``kept``."""
    texts = docs.select("doc_id", "text")
    keyed = texts.select(F.col("doc_id").alias("_row"), F.xxhash64("text").alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(keyed.dtypes)["_row"]
    rows = settle(
        keyed.mapInArrow(_sets, f"_row {kind}, _key long, n_shingles long, class binary, signature binary"), "dedup-rows"
    )
    least = F.min(F.struct(F.col("_row").isNull().alias("none"), F.col("_row").alias("id"), F.col("_key").alias("key"), F.col("signature").alias("s")))
    classes = settle(
        rows.filter(F.col("class").isNotNull()).groupBy("class").agg(least.alias("m"))
        .select("class", F.col("m.id").alias("_id"), F.col("m.key").alias("_key"), F.col("m.s").alias("signature")), "dedup-classes",
    )
    rooted = components(links(texts, classes))
    ids = classes.select("class", "_id").join(rooted, "class", "left").select("class", "_id", F.coalesce("root", "class").alias("root"))
    smallest = ids.groupBy("root").agg(F.min("_id").alias("component_id"))
    of_class = ids.join(smallest, "root").select("class", "component_id")
    found = rows.join(of_class, "class", "left").withColumn(
        "component_id", F.when(F.col("class").isNull(), F.col("_row")).otherwise(F.col("component_id"))
    )
    return found.select(
        F.col("_row").alias("doc_id"), F.col("_key").alias("text_key"), "n_shingles", "component_id",
        F.col("_row").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with the columns of ``docs``: that with the smallest id, and the first of equal rows."""
    def keys(doc_id: Column, text_key: Column) -> list[Column]:
        """Two keys without nulls, so that the join and the window share one shuffle of the texts."""
        return [F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")).alias("_id"), text_key.alias("_key")]

    gone = dedup(docs).filter(~F.col("kept")).select(*keys(F.col("doc_id"), F.col("text_key"))).distinct()
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *keys(F.col("doc_id"), F.xxhash64("text")),
        F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("_words"),
    )
    left = rows.join(gone, ["_id", "_key"], "left_anti")
    # Rows with one id and one text are one document, unless it has no words.
    place = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.lit(1)))
    return left.withColumn("_n", place).filter((F.col("_n") == 1) | ~F.col("_words")).select("_row.*")
