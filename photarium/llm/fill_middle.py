"""Fill-in-middle rearrangement of texts by displacement scatter, and its inverse by gather.

A text is cut at two line ends into prefix, middle and suffix, and laid out as ``<P>``prefix``<S>``
suffix``<M>``middle (psm) or ``<S>``suffix``<P>``prefix``<M>``middle (spm). Draws are the first
8-digit groups of the sha256 of "seed:id", so they depend on the id alone.

A task holds a batch of texts as one run of UTF-8 bytes. A scan for line feeds gives the cuts. The
three parts of a text move by one distance each; a difference array has the change of that distance
where a part begins, so its cumulative sum is the shift of every byte, and one scatter builds all
outputs. Restoring scans an output for its marks, which stand in it once each, takes the same shifts
from them, and gathers the bytes back. Both walk over the batch in windows of ``WINDOW`` bytes, so
memory beyond input and output is fixed however long a text is.

Plain (unchanged) stay empty texts, texts that contain a mark, and those the rate leaves out.

Nulls, ties, repeats: a null text is an empty one; a null id draws like empty text; equal cuts give
an empty middle; repeated rows come out alike. An empty table gives an empty one. Given columns may
have any name; of the names that an operation adds, the old column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from photarium.llm.common import slices

# The marks, of equal length, and no part of one begins another.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
SEED = 7
# Percent of texts that are rearranged, and percent of those in the form spm.
RATE, SPM = 100, 50
# Bytes for which shifts are spread out at a time.
WINDOW = 1 << 20
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM_FORM = range(3)


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts end to end, and where each begins (one more: the end)."""
    texts = pa.compute.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _texts_of(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(np.ascontiguousarray(starts, dtype=np.int64)), pa.py_buffer(data)).cast(pa.string())


def find_marks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, kind (its letter) and text number of every mark; a mark lies within one text."""
    at = np.flatnonzero(data[:-2] == ord("<")) if len(data) >= MARK else np.zeros(0, dtype=np.int64)
    letter = data[at + 1]
    marks = (data[at + 2] == ord(">")) & ((letter == PREFIX[1]) | (letter == SUFFIX[1]) | (letter == MIDDLE[1]))
    owner = np.searchsorted(starts, at, "right") - 1
    marks &= at + MARK <= starts[owner + 1]
    return at[marks], letter[marks], owner[marks]


def _moved(data: np.ndarray, begins: np.ndarray, shifts: np.ndarray, size: int, back: bool) -> np.ndarray:
    """Scatter ``data`` by the shift of each part (``back``: gather a result of ``size`` bytes from it).

    The parts that begin at ``begins``, ascending, cover the side that is walked over; of parts that
    begin together all but the last are empty. ``shifts`` is each part's way from there to the other side.
    """
    out = np.zeros(size, dtype=np.uint8)
    walked = size if back else len(data)
    changes = np.diff(shifts, prepend=0)
    base = 0
    for low in range(0, walked, WINDOW):
        high = min(low + WINDOW, walked)
        inside = slice(*np.searchsorted(begins, [low, high]))
        step = np.zeros(high - low, dtype=np.int64)
        np.add.at(step, begins[inside] - low, changes[inside])
        step[0] += base
        shift = np.cumsum(step)
        base = shift[-1]
        shift += np.arange(low, high)
        if back:
            out[low:high] = data[shift]
        else:
            out[shift] = data[low:high]
    return out


def _layout(form: np.ndarray, start: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Where prefix, middle and suffix begin in outputs that begin at ``start``."""
    prefix, middle, suffix = parts
    plain, psm = form == PLAIN, form == PSM
    mark = np.where(plain, 0, MARK)
    at_prefix = start + mark + np.where(plain | psm, 0, suffix + MARK)
    at_suffix = start + mark + np.where(plain, prefix + middle, np.where(psm, prefix + MARK, 0))
    at_middle = start + np.where(plain, prefix, prefix + suffix + 3 * MARK)
    return at_prefix, at_middle, at_suffix


def rearrange(data: np.ndarray, starts: np.ndarray, form: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All outputs of a batch, end to end, and where each begins. ``cuts`` (n, 2) are places in ``data``."""
    begin, end = starts[:-1], starts[1:]
    low, high = cuts[:, 0], cuts[:, 1]
    out_starts = np.append(0, np.cumsum(end - begin + np.where(form == PLAIN, 0, 3 * MARK)))
    places = _layout(form, out_starts[:-1], (low - begin, high - low, end - high))
    begins = np.column_stack([begin, low, high]).ravel()
    shifts = np.column_stack([places[0] - begin, places[1] - low, places[2] - high]).ravel()
    out = _moved(data, begins, shifts, int(out_starts[-1]), False)
    marked = form != PLAIN
    for place, mark in zip(places, (PREFIX, MIDDLE, SUFFIX)):
        out[(place[marked, None] - MARK) + np.arange(MARK)] = np.frombuffer(mark, dtype=np.uint8)
    return out, out_starts


def restore_all(data: np.ndarray, starts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch of outputs, end to end, and where each begins."""
    begin, end = starts[:-1], starts[1:]
    at, letter, owner = find_marks(data, starts)
    place = {}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        place[mark] = np.zeros(len(begin), dtype=np.int64)
        own = letter == mark[1]
        place[mark][owner[own]] = at[own]
    plain, psm = form == PLAIN, form == PSM
    prefix = np.where(plain, end - begin, np.where(psm, place[SUFFIX], place[MIDDLE]) - place[PREFIX] - MARK)
    suffix = np.where(plain, 0, np.where(psm, place[MIDDLE], place[PREFIX]) - place[SUFFIX] - MARK)
    middle = np.where(plain, 0, end - place[MIDDLE] - MARK)
    text_starts = np.append(0, np.cumsum(prefix + middle + suffix))
    begins = np.column_stack([text_starts[:-1], text_starts[:-1] + prefix, text_starts[:-1] + prefix + middle])
    places = np.column_stack(_layout(form, begin, (prefix, middle, suffix)))
    return _moved(data, begins.ravel(), (places - begins).ravel(), int(text_starts[-1]), True), text_starts


def code_points(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Number of code points between two places of each text; places ascend from text to text."""
    if not len(low):
        return np.zeros(0, dtype=np.int64)
    leads = np.append((data & 0xC0) != 0x80, False).view(np.uint8)
    sums = np.add.reduceat(leads, np.column_stack([low, high]).ravel(), dtype=np.int64)[::2]
    return np.where(high > low, sums, 0)


def _transform(rate: int, spm: int):
    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, starts = _bytes_of(batch.column("text"))
            begin, end = starts[:-1], starts[1:]
            feeds = np.flatnonzero(data == ord("\n"))
            first, last = np.searchsorted(feeds, begin), np.searchsorted(feeds, end)
            open_end = (end > begin) & (data[np.maximum(end - 1, 0)] != ord("\n")) if len(data) else np.zeros(len(begin), dtype=bool)
            units = last - first + open_end
            h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))

            def place(unit: np.ndarray) -> np.ndarray:
                """Where the first ``unit`` units of each text end."""
                if not len(feeds):
                    return np.where(unit == 0, begin, end)
                ended = feeds[np.clip(first + unit - 1, 0, len(feeds) - 1)] + 1
                return np.where(unit == 0, begin, np.where(unit > last - first, end, ended))

            one, two = h1 % (units + 1), h2 % (units + 1)
            cuts = np.column_stack([place(np.minimum(one, two)), place(np.maximum(one, two))])
            marked = np.zeros(len(begin), dtype=bool)
            marked[find_marks(data, starts)[2]] = True
            plain = (begin == end) | marked | (h3 % 100 >= rate)
            form = np.where(plain, PLAIN, np.where(h4 % 100 < spm, SPM_FORM, PSM))
            out, out_starts = rearrange(data, starts, form, cuts)
            counted = [code_points(data, begin, cuts[:, 0]), code_points(data, cuts[:, 0], cuts[:, 1])]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array(units.astype(np.int64)), pa.array(np.array(FORMS, dtype=object)[form], pa.string()),
                *(pa.array(c, mask=plain) for c in counted), _texts_of(out, out_starts),
            ], names=["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    return transform


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "output"):
        data, starts = _bytes_of(batch.column("output"))
        form = pa.compute.index_in(batch.column("form"), pa.array(FORMS)).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column("row"), _texts_of(*restore_all(data, starts, form))], names=["row", "restored"])


def _row(df: DataFrame, *without: str) -> tuple[list[str], Column]:
    """The given columns but those, and one column that holds them whatever their names."""
    given = [c for c in df.columns if c not in without]
    return given, F.struct(*([F.col(f"`{c}`") for c in given] or [F.lit(None).cast("int").alias("none")])).alias("row")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` in place of ``text``."""
    added = StructType().add("n", LongType()).add("form", StringType()).add("prefix_chars", LongType()).add("middle_chars", LongType()).add("output", StringType())
    given, row = _row(docs, "text", *added.names)
    h = [d.alias(f"h{i}") for i, d in enumerate(draws(F.col("doc_id"), seed), 1)]
    rows = docs.select(row, "text", *h)
    out = rows.mapInArrow(_transform(rate, spm), StructType([rows.schema["row"], *added.fields]))
    return out.select(*(F.col(f"row.`{c}`") for c in given), *added.names)


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` with ``restored``, the text that ``output`` and ``form`` came from."""
    given, row = _row(outputs, "restored")
    rows = outputs.select(row, "output", "form")
    out = rows.mapInArrow(_restore, StructType([rows.schema["row"]]).add("restored", StringType()))
    return out.select(*(F.col(f"row.`{c}`") for c in given), "restored")


def digest(docs: DataFrame) -> DataFrame:
    """Checksums of all outputs, and of the texts restored from them."""
    found = restore(transform(docs.select("doc_id", "text")))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
