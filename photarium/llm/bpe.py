"""Byte-level BPE encoding and decoding by a shuffle of distinct words.

Texts are cut into pre-tokens ("words") by a pattern; no merge crosses a word. Encoding goes in
four steps:

1. Each task explodes blocks of about ``BLOCK_BYTES`` of text into words with their positions. A
   block lists each of its words once, in ``SLICES`` lists by the word's hash, and keeps position by
   position which of its words stands there. This is written once.
2. The lists are shuffled by slice, so all copies of a word meet in one task, which encodes it once
   (again only where a slice has more than ``KNOWN_WORDS`` words). A frequent word comes once per
   block, not per occurrence, and the lists of every ``SALT_PARTITIONS`` input partitions go apart.
3. The ids return to their blocks by a second shuffle, in lists as the words came.
4. Each block's documents meet them there, and ids are laid out by position.

Lists travel as compressed bytes, which is a fraction of what rows of single words take.

Decoding joins each id to the bytes of its token. That table has a row per rank of the file, so its
size is fixed, and every task holds it.

Ranks come from a file of lines "base64 rank", read by the driver at the path given.

Nulls, ties, repeats: a null text is an empty one, with no ids; null ids and repeated rows are rows
like others; null ``ids`` decode to null. An empty table gives an empty one. Of very long texts a
single one is a block. Given columns may have any name but ``ids`` (encoding) and ``bytes``
(decoding), which are replaced; ``text`` goes, as the ids hold it.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from zstandard import ZstdCompressor, ZstdDecompressor

from photarium.llm.common import settle, slices

# Bytes of text that a task takes apart together; a longer text is a block of its own.
BLOCK_BYTES = 24 << 20
# Lists that a block's words are dealt into by their hash; at most 256, so that a slice is a byte.
SLICES = 256
# Input partitions whose copies of a word are encoded together.
SALT_PARTITIONS = 4_096
# Words whose ids a task remembers.
KNOWN_WORDS = 500_000
# Numbers worked on at a time.
CHUNK = 1 << 19
# Stands between the words of a list; no byte of UTF-8.
_BETWEEN = b"\xff"
# Bits of a block's number that count within its input partition.
_OFFSET_BITS = 33


def read_ranks(path: str) -> bytes:
    """The rank file as it is."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def token_ranks(ranks: bytes) -> dict[bytes, int]:
    """Rank of each token."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}


@lru_cache(maxsize=2)
def token_table(ranks: bytes) -> pa.LargeBinaryArray:
    """Bytes of each id; null where the file has no such rank."""
    known = token_ranks(ranks)
    table: list[bytes | None] = [None] * (max(known.values(), default=-1) + 1)
    for token, rank in known.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: neighbours with the lowest rank merge first, the leftmost of equals before others."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    # Parts by the place they start at; a merged part takes over the places of its right neighbour.
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, left, stop = heapq.heappop(waiting)
        right = end[left]
        # A part that merged meanwhile ends elsewhere, one that was taken over has no end.
        if not right or right >= n or end[right] != stop:
            continue
        end[left], end[right] = stop, 0
        if stop < n:
            before[stop] = left
            rank = ranks.get(word[left:end[stop]])
            if rank is not None:
                heapq.heappush(waiting, (rank, left, end[stop]))
        if left:
            first = before[left]
            rank = ranks.get(word[first:stop])
            if rank is not None:
                heapq.heappush(waiting, (rank, first, stop))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at:end[at]]])
        at = end[at]
    return ids


def _grouped(values: np.ndarray) -> bytes:
    width = np.ones(len(values), dtype=np.uint8)
    for bits in (7, 14, 21, 28):
        width += values >= 1 << bits
    ends = np.cumsum(width, dtype=np.int64)
    out = np.zeros(int(ends[-1]), dtype=np.uint8)
    first = ends - width
    for group in range(int(width.max())):
        has = np.flatnonzero(width > group)
        more = (width[has] > group + 1).astype(np.uint8) << 7
        out[first[has] + group] = (values[has] >> np.uint32(7 * group)).astype(np.uint8) & 127 | more
    return out.tobytes()


def _ungrouped(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    first = np.append(0, ends[:-1] + 1)
    width = ends - first + 1
    values = np.zeros(len(ends), dtype=np.uint32)
    for group in range(int(width.max())):
        has = np.flatnonzero(width > group)
        values[has] |= (raw[first[has] + group] & 127).astype(np.uint32) << np.uint32(7 * group)
    return values


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2^32 - 1 in 7-bit groups, lowest first, compressed."""
    values = numbers.astype(np.uint32, copy=False)
    return ZstdCompressor().compress(b"".join(_grouped(values[at:at + CHUNK]) for at in range(0, len(values), CHUNK)))


def unpacked(data: bytes) -> np.ndarray:
    """What ``packed`` was given."""
    raw = np.frombuffer(ZstdDecompressor().decompress(data), dtype=np.uint8)
    parts, at = [np.zeros(0, dtype=np.uint32)], 0
    while at < len(raw):
        stop = min(at + CHUNK, len(raw))
        while raw[stop - 1] >= 128:  # a number goes on
            stop += 1
        parts.append(_ungrouped(raw[at:stop]))
        at = stop
    return np.concatenate(parts)


def _frequencies(places: np.ndarray, n: int) -> np.ndarray:
    """How often each number below ``n`` occurs."""
    counts = np.zeros(n, dtype=np.int64)
    for at in range(0, len(places), CHUNK):
        counts += np.bincount(places[at:at + CHUNK], minlength=n)
    return counts


def _explode(pattern: str, block_bytes: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block one row with its documents and their words by number, and its words in rows by slice."""
        find = regex.compile(pattern).findall
        for batch in slices(batches, chars=block_bytes):
            seen: dict[str, int] = {}
            number = seen.setdefault
            found = [np.fromiter((number(w, len(seen)) for w in find(t.as_py())), dtype=np.uint32) for t in batch.column("text")]
            # Frequent words get small numbers; a list has its slice's words by number.
            sizes, places = list(map(len, found)), np.concatenate(found)
            del found
            often = np.argsort(-_frequencies(places, len(seen)), kind="stable")
            rank = np.empty(len(seen), dtype=np.uint32)
            rank[often] = np.arange(len(seen), dtype=np.uint32)
            coded = [w.encode() for w in seen]
            own = np.fromiter((crc32(coded[i]) % SLICES for i in often), dtype=np.uint8, count=len(coded))
            listed = np.argsort(own, kind="stable")
            kinds, first = np.unique(own[listed], return_index=True)
            lists = [_BETWEEN.join([coded[often[i]] for i in part]) for part in np.split(listed, first[1:])] if len(kinds) else []
            n, block, rows = len(kinds), batch.column("at")[0].as_py(), batch.column("row")
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n + 1, block)),
                pa.concat_arrays([pa.nulls(1, pa.int32()), pa.array(kinds.astype(np.int32))]),
                pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.nulls(n, pa.list_(rows.type))]),
                pa.array([sizes] + [None] * n, pa.list_(pa.int64())),
                pa.array([own.tobytes()] + [None] * n, pa.binary()),
                pa.array([packed(np.take(rank, places, out=places))] + [ZstdCompressor().compress(words) for words in lists], pa.binary()),
            ], names=["block", "slice", "rows", "sizes", "dealt", "packed"])

    return explode


def _encode(ranks: bytes):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number of ids and ids of the words of each list; a word of the slice that came before is looked up."""
        known, done, current = token_ranks(ranks), {}, None
        for batch in batches:
            out = []
            for part, data in zip(batch.column("slice").to_pylist(), batch.column("packed").to_pylist()):
                if part != current:
                    done, current = {}, part
                found = []
                for word in ZstdDecompressor().decompress(data).split(_BETWEEN):
                    ids = done.get(word)
                    if ids is None:
                        if len(done) >= KNOWN_WORDS:
                            done.clear()
                        ids = done[word] = encode_word(word, known)
                    found.append(ids)
                out.append(packed(np.array([len(found), *map(len, found), *chain.from_iterable(found)], dtype=np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("slice"), pa.array(out, pa.binary())], names=["block", "slice", "packed"])

    return encode


def bytes_of(ids: pa.ListArray, table: pa.LargeBinaryArray) -> pa.BinaryArray:
    """What lists of ids stand for: one gather from the token table, end to end in a list."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    flat = table.take(ids.flatten())
    if flat.null_count:
        raise ValueError("an id that the ranks do not have")
    tokens = np.append(0, np.cumsum(sizes))
    starts = np.frombuffer(flat.buffers()[1], dtype=np.int64)[tokens] if len(flat) else tokens
    data = flat.buffers()[2] if len(flat) else pa.py_buffer(b"")
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(starts, dtype=np.int64)), data])
    return pa.compute.if_else(ids.is_null(), pa.scalar(None, pa.large_binary()), whole).cast(pa.binary())


def _parts(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of lists that end at ``ends`` (first: 0) with about ``CHUNK`` values together."""
    at = 0
    while at < len(ends) - 1:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        yield at, stop
        at = stop


def _assemble(ranks: bytes | None):
    def assemble(documents: pa.Table, lists: pa.Table) -> pa.Table:
        """A block's documents with the ids of their words, position by position; with ``ranks`` decoded, too."""
        rows = documents.column("rows").combine_chunks().flatten()
        ends = np.append(0, np.cumsum(documents.column("sizes")[0].values.to_numpy()))
        sizes, ids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for data in lists.sort_by("slice").column("packed"):
            numbers = unpacked(data.as_py())
            words = int(numbers[0])
            sizes.append(numbers[1:words + 1].astype(np.int64))
            ids.append(numbers[words + 1:].astype(np.int32))
        starts = np.append(0, np.cumsum(np.concatenate(sizes)))
        by_list = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(ids)))
        # The lists have the words by slice, and in a slice by number.
        dealt = np.frombuffer(documents.column("dealt")[0].as_py(), dtype=np.uint8)
        place = np.empty(len(dealt), dtype=np.int32)
        place[np.argsort(dealt, kind="stable")] = np.arange(len(dealt), dtype=np.int32)
        places = unpacked(documents.column("packed")[0].as_py())
        laid, decoded = [], []
        for at, stop in _parts(ends):
            words = by_list.take(pa.array(place[places[ends[at]:ends[stop]]]))
            laid.append(pa.ListArray.from_arrays(pa.array(words.offsets.to_numpy()[ends[at:stop + 1] - ends[at]], pa.int32()), words.values))
            if ranks is not None:
                decoded.append(bytes_of(laid[-1], token_table(ranks)))
        columns = {"row": pa.chunked_array([rows], rows.type), "ids": pa.chunked_array(laid, by_list.type)}
        return pa.table(columns if ranks is None else columns | {"bytes": pa.chunked_array(decoded, pa.binary())})

    return assemble


def encode(docs: DataFrame, ranks: bytes, pattern: str, block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` in place of ``text``; with ``decoded`` also with ``bytes``, as ``decode`` adds them."""
    added = StructType().add("ids", ArrayType(IntegerType()))
    if decoded:
        added = added.add("bytes", "binary")
    given = [c for c in docs.columns if c not in ("text", *added.names)]
    # A struct needs a field even if no column but the text is given.
    fields = [F.col(f"`{c}`") for c in given] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(
        F.monotonically_increasing_id().alias("at"), F.struct(*fields).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    schema = (
        StructType().add("block", "long").add("slice", "integer").add("rows", ArrayType(rows.schema["row"].dataType))
        .add("sizes", ArrayType(LongType())).add("dealt", "binary").add("packed", "binary")
    )
    blocks = settle(rows.mapInArrow(_explode(pattern, block_bytes), schema), "bpe-blocks")
    salt = F.floor(F.shiftright("block", _OFFSET_BITS) / SALT_PARTITIONS)
    lists = blocks.filter(F.col("slice").isNotNull()).select("block", "slice", "packed").repartition("slice", salt).sortWithinPartitions("slice")
    ids = lists.mapInArrow(_encode(ranks), "block long, slice int, packed binary")
    documents = blocks.filter(F.col("slice").isNull()).select(F.col("block").alias("of"), "rows", "sizes", "dealt", "packed")
    row = StructField("row", documents.schema["rows"].dataType.elementType)
    laid = documents.groupBy("of").cogroup(ids.groupBy("block")).applyInArrow(
        _assemble(ranks if decoded else None), StructType([row, *added.fields])
    )
    return laid.select(*(F.col(f"row.`{c}`") for c in given), *added.names)


def decode(tokens: DataFrame, ranks: bytes) -> DataFrame:
    """``tokens`` with ``bytes``, what their ``ids`` stand for."""
    given = [c for c in tokens.columns if c != "bytes"]
    rows = tokens.select(F.struct(*(F.col(f"`{c}`") for c in given)).alias("row"), "ids")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            for at, stop in _parts(np.append(0, np.cumsum(sizes))):
                part = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([part.column("row"), bytes_of(part.column("ids"), token_table(ranks))], names=["row", "bytes"])

    out = rows.mapInArrow(joined, StructType([rows.schema["row"]]).add("bytes", "binary"))
    return out.select(*(F.col(f"row.`{c}`") for c in given), "bytes")


def digest(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Checksums of the ids of all documents, and of what they decode to."""
    return encode(docs.select("doc_id", "text"), ranks, pattern, decoded=True).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
