"""Benchmark decontamination with suffix arrays of the training text.

Each shard of documents (a slice of a partition) gets a suffix array of its words. Every window
of a benchmark item is looked up in it by binary search; the suffixes in the range found are
all the places where the window stands. Windows that follow each other merge into the longest
verbatim matches, with their first word and length.

A suffix can only match if it starts with as many known words (words of the items) as the
shortest window has. Words that no item has end a suffix, and suffixes that are too short stay
out of the array; nothing that could match is lost.

Items are sent to all tasks, which is only done for a bounded number: they are split by hash
into blocks of about ``BLOCK_BYTES``, and the documents pass through one block after another,
without a shuffle, each adding its matches. Of more than one block each pass is written down before
the next, so driver and tasks hold one block whatever the number of items.

Nulls and repeats: a null or empty text has no words and cannot match; a null item id counts as
empty text; items or documents that occur twice match like one; empty tables match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from photarium.llm.common import settle, slices
from photarium.session import drop_path, scratch_path

WINDOW = 10
BLOCK_BYTES = 8 << 20
# Words are runs of ASCII letters, digits and all characters beyond ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPAN = StructType().add("start", LongType()).add("length", LongType())


def words(text: str | bytes | None) -> list[bytes]:
    """The words of a text, A to Z in lower case."""
    if text is None:
        return []
    return _WORD.findall((text if isinstance(text, bytes) else text.encode()).lower())


class Windows:
    """The windows of a block of items, by length."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WINDOW):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[bytes, set[int]]] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=">u4")
            size = min(width, len(ids))
            for start in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(ids[start:start + size].tobytes(), set()).add(number[name])
        self.by_size = {n: (list(w), [sorted(s) for s in w.values()]) for n, w in sorted(found.items())}
        self.shortest = min(self.by_size, default=width)

    def matches(self, documents: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set[int]]]:
        """For each document its longest matches (first word, words) and the items with matching windows."""
        spans: list[list[tuple[int, int]]] = [[] for _ in documents]
        items: list[set[int]] = [set() for _ in documents]
        if not self.by_size:
            return spans, items
        known = self.vocabulary.get
        # One stop (0) after every document, so that no suffix runs into the next.
        flat: list[int] = []
        begins = np.zeros(len(documents) + 1, dtype=np.int64)
        for i, doc in enumerate(documents):
            flat.extend([known(w, 0) for w in doc])
            flat.append(0)
            begins[i + 1] = len(flat)
        text = np.array(flat + [0] * self.width, dtype=np.uint32)
        stops = np.flatnonzero(text == 0)
        position = np.arange(begins[-1])
        room = stops[np.searchsorted(stops, position)] - position
        suffixes = np.flatnonzero(room >= self.shortest)
        if not len(suffixes):
            return spans, items
        # The array in order of the first `width` words; what stands behind a stop does not count.
        keys = text[suffixes[:, None] + np.arange(self.width)]
        keys[np.arange(self.width) >= room[suffixes][:, None]] = 0
        packed = np.ascontiguousarray(keys.astype(">u4")).view(f"S{4 * self.width}").ravel()
        order = np.argsort(packed, kind="stable")
        array, packed = suffixes[order], packed[order]
        cover = np.zeros(len(text) + 1, dtype=np.int64)
        for size, (windows, owners) in self.by_size.items():
            fill = 4 * (self.width - size)
            low = np.searchsorted(packed, np.array([w + b"\x00" * fill for w in windows], dtype=packed.dtype), "left")
            high = np.searchsorted(packed, np.array([w + b"\xff" * fill for w in windows], dtype=packed.dtype), "right")
            for at in np.flatnonzero(high > low):
                places = array[low[at]:high[at]]
                np.add.at(cover, places, 1)
                np.add.at(cover, places + size, -1)
                for doc in np.unique(np.searchsorted(begins, places, "right") - 1):
                    items[doc].update(owners[at])
        inside = np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8), [0]))
        edge = np.diff(inside)
        for start, stop in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            doc = int(np.searchsorted(begins, start, "right") - 1)
            spans[doc].append((int(start - begins[doc]), int(stop - start)))
        return spans, items


def _merged(own: list[dict], more: list[tuple[int, int]]) -> list[dict]:
    """Two lists of spans as one without overlaps."""
    out: list[dict] = []
    for start, length in sorted([(s["start"], s["length"]) for s in own] + more):
        if out and start <= out[-1]["start"] + out[-1]["length"]:
            out[-1]["length"] = max(out[-1]["length"], start + length - out[-1]["start"])
        else:
            out.append({"start": start, "length": length})
    return out


def _matcher(windows: Windows, schema: pa.Schema):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            split = [words(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            spans, items = windows.matches(split)
            had, names = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            new = {
                "n_words": [len(w) for w in split],
                "spans": [_merged(h, s) for h, s in zip(had, spans)],
                "items": [n + [windows.names[i] for i in sorted(found)] for n, found in zip(names, items)],
            }
            columns = [pa.array(new[f.name], type=f.type) if f.name in new else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return match


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def find(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (the longest matches, in words) and ``items`` (ids as text, sorted)."""
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter(F.col("text").isNotNull())
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-total // block_bytes))
    added = {"n_words", "spans", "items"}
    out = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in added)).withColumns({
        "n_words": F.lit(0).cast("bigint"), "spans": F.array().cast(ArrayType(SPAN)), "items": F.array().cast(ArrayType(StringType())),
    })
    schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in out.schema.fields])
    of_block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    before = None
    for block in range(blocks):  # one block of bounded size at a time
        rows = tests.filter(of_block == block).distinct().collect()
        out = out.mapInArrow(_matcher(Windows([(r["item_id"], r["text"]) for r in rows], width), schema), out.schema)
        if blocks > 1:  # the next block begins when this one has left driver and plan
            path = scratch_path(docs.sparkSession, "decontamination")
            out = settle(out, "decontamination", path)
            if before:
                drop_path(docs.sparkSession, before)
            before = path
    return out.withColumn("items", F.array_sort(F.array_distinct("items")))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any match, with the columns of ``docs``."""
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return find(rows, benchmark).filter(F.size("spans") == 0).select("_row.*")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts of hit words and items per document."""
    found = find(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["length"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
