"""Score texts with a log-bilinear neural language model.

Word counts of the whole training part come first, exact and by grouped aggregation. The model
predicts entries: the end of a text, each of the ``WORDS`` most frequent words, and ``SHAPES`` groups
of the other words by their last letters. An entry has a vector for being predicted and one for
standing in a context; a word outside the vocabulary stands there as its group. The prediction is the
sum of the vectors of the ``CONTEXT`` tokens before, each scaled by a vector of its position.

Probabilities are normalised over two levels: the entries are dealt into classes of ``WIDTH`` by
frequency; a class scores by its product with the prediction, plus a bias, among all classes, and an
entry likewise within its class. A word of a group costs its group and its share, by smoothed counts,
of the group, in which all unseen words are one. So the probabilities of everything that can follow
sum to one.

Training is noise-contrastive estimation in numpy: at both levels what was observed must be told from
noise drawn by frequency. Batches are of random stretches of ``STRETCH`` tokens, as neighbours share most
of their contexts and so the work on them. Training runs where the texts are: in each of ``ROUNDS`` rounds every task takes
the model over a hashed share of its documents, and the models of the tasks are averaged, row by row,
weighted by their tokens. A share is 1 in ``SHARE`` documents, another one each round, so that all rounds
together learn from every training document (from a small corpus, where that would leave less than
``LEAST_TOKENS``, from more of them each round, and more than once). For scoring, batched matrix products
give the token log-probabilities of all documents.

Counts of words that stand for at least one in ``FREQUENT`` training tokens (so at most that many
words) go to all tasks; the rest are joined, without any word that could be a hot key. Words are known
by 64-bit hashes; two of n words share one with a chance of n^2 / 2^65.

Nulls, ties and repeats: a null or empty text is its end token only; a null id counts as empty text
in the fold; repeated rows are scored and counted like others; of equally frequent words the smaller
hash comes first. A very long text is worked on in pieces. Only ``doc_id`` and ``text`` are read, so
other columns cannot clash. Without training rows every word is unknown and the model knows no more
than the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photarium.llm.common import bucket_of, scores_of, settle, slices

FOLDS, HELD_OUT = 7, 2
FREQUENT = 500_000
# Entries: the end, words, groups of words by their last letters; so many to a class.
WORDS, SHAPES, WIDTH = 3_071, 1_024, 128
LAST_BYTES = 3
# Tokens that a task counts together before it passes counts on, and scores together.
COUNT_TOKENS, CHUNK = 4_000_000, 1 << 15

# Training. A batch has 1 in BATCHES of the tokens at hand, BATCH at least and MOST_BATCH at most.
CONTEXT, DIMENSIONS = 5, 24
ROUNDS, SHARE, LEAST_TOKENS, MOST_PASSES = 3, 3, 250_000, 30
BATCH, MOST_BATCH, BATCHES, NOISE, RATE = 1_024, 4_096, 64, 64, 0.3
# Tokens in a row that go into a batch together; more than the CONTEXT - 1 ends between texts.
STRETCH = 8
NONE = -1e9

# The end of a text is a token; no word has a blank in it.
_END = b" "
_END_HASH = pd.util.hash_array(np.array([_END], dtype=object), categorize=False).view(np.int64)[0]


def _hashes(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words, categorize=False).view(np.int64)


@dataclass
class Tokens:
    """The tokens of a batch of texts, end to end: distinct words, which of them each token is, and each text's length."""

    hashes: np.ndarray
    shapes: np.ndarray
    codes: np.ndarray
    lengths: np.ndarray


def tokens(texts: pa.Array | list[bytes | None]) -> Tokens:
    """Words of texts in UTF-8, lower-cased, each text with its end."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.binary()).cast(pa.string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    distinct = coded.dictionary.cast(pa.binary())
    # Blanks at either end of a text leave empty parts, which are no words.
    is_word = pc.binary_length(distinct).to_numpy() > 0
    found = is_word[codes]
    before = np.append(0, np.cumsum(found))[parts.offsets.to_numpy()]
    codes = (np.cumsum(is_word) - 1)[codes[found]]
    distinct = pa.concat_arrays([distinct.filter(pa.array(is_word)), pa.array([_END])])
    last = pc.binary_slice(distinct, -LAST_BYTES).dictionary_encode()
    groups = (_hashes(last.dictionary.to_numpy(zero_copy_only=False)).view(np.uint64) % np.uint64(SHAPES)).astype(np.int32)
    return Tokens(
        _hashes(distinct.to_numpy(zero_copy_only=False)), groups[last.indices.to_numpy()],
        np.insert(codes, before[1:], len(distinct) - 1), np.diff(before) + 1,
    )


@dataclass
class Vocabulary:
    """What the tasks have to know of the training counts."""

    total: int
    distinct: int
    words: np.ndarray  # hashes of the frequent words, ascending
    counts: np.ndarray
    named: np.ndarray  # hashes of the words that are entries, ascending
    place: np.ndarray  # entry of each
    groups: np.ndarray  # entry of each group
    mass: np.ndarray  # smoothed count of each entry

    @property
    def classes(self) -> int:
        return -(-len(self.mass) // WIDTH)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Training count of each word if it is frequent, else -1."""
        if not len(self.words):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.counts[at], -1)

    def entries(self, hashes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each word, and whether it is the word's own."""
        at = np.minimum(np.searchsorted(self.named, hashes), len(self.named) - 1)
        own = self.named[at] == hashes
        return np.where(own, self.place[at], self.groups[shapes]), own


@dataclass
class Model:
    """Vectors of contexts, positions, classes and entries; the last column of the latter two is a bias."""

    context: np.ndarray  # (entries, dimensions)
    positions: np.ndarray  # (CONTEXT, dimensions)
    classes: np.ndarray  # (classes, dimensions + 1)
    entries: np.ndarray  # (classes, WIDTH, dimensions + 1)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.positions, self.classes, self.entries]

    def rows(self) -> np.ndarray:
        """All vectors below each other, of one width."""
        wide = DIMENSIONS + 1
        return np.concatenate([
            np.pad(p.reshape(-1, p.shape[-1]), ((0, 0), (0, wide - p.shape[-1]))) for p in self.parts()
        ])

    def of_rows(self, rows: np.ndarray) -> Model:
        """A model of this shape from such rows."""
        found, at = [], 0
        for p in self.parts():
            n = p.size // p.shape[-1]
            found.append(np.ascontiguousarray(rows[at:at + n, :p.shape[-1]].reshape(p.shape), dtype=np.float32))
            at += n
        return Model(*found)

    def wide(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of contexts and positions with one more column, in which predictions get a one for the biases."""
        context, positions = np.ones((len(self.context), DIMENSIONS + 1), np.float32), np.zeros((CONTEXT, DIMENSIONS + 1), np.float32)
        context[:, :-1], positions[:, :-1], positions[0, -1] = self.context, self.positions, 1
        return context, positions

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """Predictions from the entries of the tokens before (n, CONTEXT), with a one for the biases."""
        context, positions = self.wide()
        total = _rows(context * positions[0], before[:, 0])
        for place in range(1, CONTEXT):
            total += _rows(context * positions[place], before[:, place])
        return total

    def log_probabilities(self, before: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Natural log-probability of each entry in its context."""
        order = _order(entry)
        predicted = self.predicted(_rows(before, order))
        kind, within = np.divmod(entry[order], WIDTH)
        logs = _log_softmax(predicted, self.classes, kind)
        bounds = np.searchsorted(kind, np.arange(len(self.classes) + 1))
        for c in np.flatnonzero(np.diff(bounds)):
            rows = slice(bounds[c], bounds[c + 1])
            logs[rows] += _log_softmax(predicted[rows], self.entries[c], within[rows])
        total = np.empty(len(entry))
        total[order] = logs
        return total


def _rows(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values[at]``, which takes several times as long."""
    return np.take(values, at, axis=0, mode="clip")


def _before(values: np.ndarray, place: int) -> np.ndarray:
    """Of values of stretches (n, STRETCH + CONTEXT, width), those at ``place`` + 1 before each token, as (n, STRETCH * width)."""
    width = values.shape[2]
    first = (CONTEXT - 1 - place) * width
    return values.reshape(len(values), -1)[:, first:first + STRETCH * width]


def _order(entry: np.ndarray) -> np.ndarray:
    """Stable order of entries; integers of 16 bits are sorted by their digits."""
    return np.argsort(entry.astype(np.min_scalar_type(entry.max(initial=0))), kind="stable")


def _log_softmax(predicted: np.ndarray, vectors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    products = predicted @ vectors.T
    own = products[np.arange(len(products)), chosen]
    # Sums of exponentials that could leave the range of the type are taken below the largest product.
    if products.max() > 60 or own.min() < -60:
        products -= products.max(1, keepdims=True)
        own = products[np.arange(len(products)), chosen]
    return own.astype(np.float64) - np.log(np.exp(products, out=products) @ np.ones(len(vectors), dtype=products.dtype))


def new_model(known: Vocabulary, seed: int = 7) -> Model:
    """Small random vectors; biases say the smoothed frequencies."""
    rng = np.random.default_rng(seed)
    mass = np.zeros(known.classes * WIDTH)
    mass[:len(known.mass)] = known.mass
    mass = mass.reshape(known.classes, WIDTH)

    def with_bias(share: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            bias = np.maximum(np.log(share), NONE)
        return np.concatenate([rng.normal(0, 0.05, (*share.shape, DIMENSIONS)), bias[..., None]], axis=-1).astype(np.float32)

    return Model(
        rng.normal(0, 0.1, (known.classes * WIDTH, DIMENSIONS)).astype(np.float32),
        np.linspace(1.0, 0.5, CONTEXT)[:, None].repeat(DIMENSIONS, 1).astype(np.float32),
        with_bias(mass.sum(1) / mass.sum()), with_bias(mass / mass.sum(1, keepdims=True)),
    )


def contexts(entry: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The entries of the ``CONTEXT`` tokens before each, nearest first; before a text stand ends."""
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.arange(len(entry))
    before = np.full((len(entry), CONTEXT), end, dtype=np.int32)
    for place in range(CONTEXT):
        inside = at - place - 1 >= first
        before[inside, place] = entry[at[inside] - place - 1]
    return before


def laid_out(entry: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens in a row with ``CONTEXT`` ends before each text, and the place of each token there.

    The ``CONTEXT`` before a token are those of ``contexts``; the end of a text is one of the ends before the next.
    """
    at = np.arange(len(entry)) + CONTEXT + np.repeat(np.arange(len(lengths)) * (CONTEXT - 1), lengths)
    row = np.full(at[-1] + 1 if len(at) else CONTEXT, end, dtype=np.int32)
    row[at] = entry
    return row, at


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``at``."""
    if (at[1:] < at[:-1]).any():
        order = _order(at)
        at, values = at[order], _rows(values, order)
    total = np.zeros((size, values.shape[1]), dtype=np.float32)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    total[at[first]] = np.add.reduceat(values, first, axis=0)
    return total


def contrast(
    predicted: np.ndarray, vectors: np.ndarray, share: np.ndarray, seen: np.ndarray, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the noise-contrastive loss by predictions and by vectors, summed over a batch.

    Each observation must be told from ``NOISE`` draws by ``share``, with products taken as log-probabilities;
    what is drawn m times counts m times.
    """
    wide = np.concatenate([predicted, np.ones((len(predicted), 1), dtype=predicted.dtype)], axis=1)
    back, slope = contrasts(wide, vectors[None], share[None], np.array([0, len(seen)]), seen, rng)
    return back[:, :-1], slope[0]


def contrasts(
    predicted: np.ndarray, vectors: np.ndarray, share: np.ndarray, bounds: np.ndarray, seen: np.ndarray, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """``contrast`` of several sets of vectors (sets, size, dimensions + 1), each with noise of its own.

    The rows between ``bounds`` c and c + 1 belong to set c. Predictions end with a one, for the biases;
    ``seen`` counts through all sets. Noise that was not drawn has no slope and is left out.
    """
    sets, size, wide = vectors.shape
    times = rng.multinomial(NOISE, share).astype(predicted.dtype)
    against = -vectors
    against[..., -1] += np.log(NOISE * np.maximum(share, 1e-12)).astype(predicted.dtype)
    against = against.reshape(-1, wide)

    # What was observed.
    own = _rows(against, seen)
    missing = np.einsum("ij,ij->i", predicted, own)
    with np.errstate(over="ignore"):
        missing = 1 / (1 + np.exp(-missing))  # one less the belief that it was observed
    back = own * missing[:, None]
    slope = _sums(seen, predicted * -missing[:, None], len(against)).reshape(vectors.shape)

    # What was drawn.
    drawn = times.ravel().nonzero()[0]
    ends = np.searchsorted(drawn, np.arange(sets + 1) * size)
    of_drawn, times, more = _rows(against, drawn), times.ravel()[drawn], np.zeros((len(drawn), wide), dtype=slope.dtype)
    with np.errstate(over="ignore"):
        for c in np.flatnonzero(np.diff(bounds)):
            part, noise = predicted[bounds[c]:bounds[c + 1]], slice(ends[c], ends[c + 1])
            belief = part @ of_drawn[noise].T
            np.exp(belief, out=belief)
            belief += 1
            np.divide(times[noise], belief, out=belief)
            more[noise] = belief.T @ part
            back[bounds[c]:bounds[c + 1]] -= belief @ of_drawn[noise]
    slope.reshape(-1, wide)[drawn] += more
    return back, slope


def train(model: Model, known: Vocabulary, entry: np.ndarray, lengths: np.ndarray, end: int, seed: int) -> Model:
    """The model after one pass over the tokens of texts, in batches of random stretches, by adaptive gradient steps."""
    rng = np.random.default_rng(seed)
    model = Model(*(p.copy() for p in model.parts()))
    past = [np.full(p.shape[:-1], 1e-2, dtype=np.float32) for p in model.parts()]
    mass = np.zeros(model.entries.shape[0] * WIDTH)
    mass[:len(known.mass)] = known.mass
    mass = mass.reshape(-1, WIDTH)
    of_class, of_entry = mass.sum(1) / mass.sum(), mass / mass.sum(1, keepdims=True)

    def step(which: int, slope: np.ndarray) -> None:
        past[which] += np.einsum("...j,...j->...", slope, slope) / slope.shape[-1]
        slope *= (RATE / np.sqrt(past[which]))[..., None]
        part = model.parts()[which]
        part -= slope

    row, at = laid_out(entry, lengths, end)
    n = -(-(len(row) - CONTEXT) // STRETCH)
    row = np.pad(row, (0, n * STRETCH + CONTEXT - len(row)), constant_values=end)
    stretches = np.lib.stride_tricks.sliding_window_view(row, STRETCH + CONTEXT)[::STRETCH]
    is_token = np.zeros((n, STRETCH), dtype=bool)
    is_token.reshape(-1)[at - CONTEXT] = True
    batch = min(MOST_BATCH, max(BATCH, len(entry) // BATCHES))
    for chosen in np.array_split(rng.permutation(n), -(-len(entry) // batch)):
        ahead = stretches[chosen].astype(np.int64)
        rows, own = np.flatnonzero(is_token[chosen]), ahead[:, CONTEXT:][is_token[chosen]]
        order = _order(own)
        rows, own = rows[order], own[order]
        kind = own // WIDTH
        context, positions = model.wide()
        stood, scales = _rows(context, ahead), np.tile(positions, STRETCH)
        predicted = sum(_before(stood, p) * scales[p] for p in range(CONTEXT))
        predicted = _rows(predicted.reshape(-1, DIMENSIONS + 1), rows)
        back, of_classes = contrasts(predicted, model.classes[None], of_class[None], np.array([0, len(rows)]), kind, rng)
        bounds = np.searchsorted(kind, np.arange(len(model.classes) + 1))
        more, of_entries = contrasts(predicted, model.entries, of_entry, bounds, own, rng)
        # A batch of more tokens takes as long a step as several of BATCH tokens.
        scale = np.float32(1 / min(len(rows), BATCH))
        back += more
        back *= scale
        spread = np.zeros((len(ahead) * STRETCH, DIMENSIONS + 1), dtype=np.float32)
        spread[rows] = back
        spread = spread.reshape(len(ahead), -1)
        moved, by_token = np.empty_like(positions), np.zeros_like(stood)
        for p in range(CONTEXT):
            moved[p] = np.einsum("ij,ij->j", spread, _before(stood, p)).reshape(STRETCH, -1).sum(0)
            part = _before(by_token, p)
            part += spread * scales[p]
        step(2, of_classes[0] * scale)
        step(3, of_entries * scale)
        # Summed over the places where an entry stood.
        step(0, _sums(ahead.ravel(), by_token.reshape(-1, DIMENSIONS + 1), len(context))[:, :-1])
        step(1, moved[:, :-1])
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a batch of texts, with their groups."""
    waiting: list[Tokens] = []
    size = 0

    def counted() -> pa.RecordBatch:
        hashes = np.concatenate([t.hashes for t in waiting])
        n = np.concatenate([np.bincount(t.codes, minlength=len(t.hashes)) for t in waiting])
        words, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(which, n, len(words)).astype(np.int64)
        shapes = np.concatenate([t.shapes for t in waiting])[first]
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(shapes), pa.array(total)], names=["word", "shape", "n"])

    for batch in slices(batches):
        waiting.append(tokens(batch.column("text")))
        size += len(waiting[-1].codes)
        if size >= COUNT_TOKENS:
            yield counted()
            waiting, size = [], 0
    if waiting:
        yield counted()


def count_words(train_part: DataFrame) -> DataFrame:
    """``word`` (hash), ``shape`` (its group) and ``n``, its number of training tokens."""
    return train_part.select("text").mapInArrow(_count, "word long, shape int, n long").groupBy("word").agg(
        F.min("shape").alias("shape"), F.sum("n").alias("n")
    )


def vocabulary(words: DataFrame) -> Vocabulary:
    """Totals, the frequent words, and the entries in order of their mass."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("d")).first()
    # At most FREQUENT words have that share of all tokens.
    often = words.filter(F.col("n") * FREQUENT >= F.lit(total["t"])).toPandas().sort_values("word")
    hashes, counts, shapes = often["word"].to_numpy(np.int64), often["n"].to_numpy(np.int64), often["shape"].to_numpy(np.int64)
    groups = words.filter(F.col("word") != F.lit(int(_END_HASH))).groupBy("shape").agg(F.sum(F.col("n") + 1).alias("m")).toPandas()  # at most SHAPES rows
    in_group = np.ones(SHAPES)
    in_group[groups["shape"].to_numpy(np.int64)] += groups["m"].to_numpy(np.float64)
    candidates = np.flatnonzero(hashes != _END_HASH)
    top = candidates[np.lexsort((hashes[candidates], -counts[candidates]))[:WORDS]]
    np.subtract.at(in_group, shapes[top], counts[top] + 1.0)
    end = counts[hashes == _END_HASH].sum() + 1.0
    mass = np.concatenate([[end], counts[top] + 1.0, in_group])
    order = np.argsort(-mass, kind="stable")
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    named = np.append(_END_HASH, hashes[top])
    sort = np.argsort(named)
    return Vocabulary(total["t"], total["d"], hashes, counts, named[sort], place[:len(named)][sort], place[len(named):], mass[order])


def _entry_of(known: Vocabulary, found: Tokens) -> np.ndarray:
    return known.entries(found.hashes, found.shapes)[0][found.codes]


def _train_task(model: Model, known: Vocabulary, seed: int, passes: int = 1):
    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of the model after the task's texts, with the number of its tokens; none without texts."""
        own, seen, end = model, 0, int(known.entries(np.array([_END_HASH]), np.zeros(1, np.int64))[0][0])
        for batch in slices(batches):
            found = tokens(batch.column("text"))
            entry = _entry_of(known, found)
            for turn in range(passes):
                own = train(own, known, entry, found.lengths, end, seed * MOST_PASSES + turn)
            seen += len(entry)
        if seen:
            rows = own.rows() * np.float64(seen)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (DIMENSIONS + 1), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), float(seen))), flat], names=["at", "weight", "row"]
            )

    return trained


def fit(train_part: DataFrame, known: Vocabulary) -> Model:
    """The model after all rounds, which together learn from every training document."""
    model = new_model(known)
    part = min(SHARE, ROUNDS, max(1, known.total // LEAST_TOKENS))
    passes = min(MOST_PASSES, max(1, LEAST_TOKENS // max(1, known.total)))
    for turn in range(ROUNDS):
        share = train_part.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(part)) == turn % part)
        rows = share.select("text").mapInArrow(_train_task(model, known, turn, passes), "at int, weight double, row array<double>")
        sums = [F.sum(F.col("row")[i]).alias(f"s{i}") for i in range(DIMENSIONS + 1)]
        mean = rows.groupBy("at").agg(F.sum("weight").alias("weight"), *sums).orderBy("at").toPandas()  # the rows of one model
        if len(mean):
            values = mean[[f"s{i}" for i in range(DIMENSIONS + 1)]].to_numpy() / mean["weight"].to_numpy()[:, None]
            model = model.of_rows(values)
    return model


def _score(known: Vocabulary, model: Model):
    """Per text one row of what is known, and a row for every word of it whose count has to be joined."""
    log_mass = np.log10(known.mass)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(known.entries(np.array([_END_HASH]), np.zeros(1, np.int64))[0][0])
        for batch in slices(batches):
            rows, found = batch.column("row").to_numpy(), tokens(batch.column("text"))
            n_texts = len(rows)
            at = np.repeat(np.arange(n_texts), found.lengths)
            counts = known.known(found.hashes)
            entries, own = known.entries(found.hashes, found.shapes)
            # Of a word without an entry: its share of the group, without its count if that is joined.
            logs = np.where(counts >= 0, np.log10(np.maximum(counts, 0) + 1.0), 0.0)
            extra = np.where(own, 0.0, logs - log_mass[entries])
            entry = entries[found.codes]
            before = contexts(entry, found.lengths, end)
            model_logs = np.concatenate([
                model.log_probabilities(before[i:i + CHUNK], entry[i:i + CHUNK]) for i in range(0, len(entry), CHUNK)
            ]) / np.log(10) + extra[found.codes]
            joined = np.flatnonzero(counts[found.codes] < 0)
            pairs, times = np.unique(at[joined] * len(found.hashes) + found.codes[joined], return_counts=True)
            pairs = np.divmod(pairs, len(found.hashes))
            m = len(times)
            add = lambda values: np.bincount(at, values, n_texts)
            some = lambda values, kind: pa.concat_arrays([pa.array(values, type=kind), pa.nulls(m, kind)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([rows, rows[pairs[0]]])),
                # Rows of texts have no word; a number of their own deals them out evenly.
                pa.array(np.concatenate([(rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), found.hashes[pairs[1]]])),
                pa.concat_arrays([pa.nulls(n_texts, pa.int64()), pa.array(times, type=pa.int64())]),
                pa.concat_arrays([batch.column("doc_id"), pa.nulls(m, batch.column("doc_id").type)]),
                some(found.lengths, pa.int64()), some(add((counts > 0).astype(float)[found.codes]).astype(np.int64), pa.int64()),
                some(add(logs[found.codes]), pa.float64()), some(add(model_logs), pa.float64()),
            ], names=["row", "word", "times", "doc_id", "n_tokens", "n_known", "logs", "model"])

    return score


def score(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, token numbers, ``base_score`` and ``score``, the model's.

    Both scores are log10-probabilities of the whole text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    train_part = rows.filter(bucket_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    words = settle(count_words(train_part), "lm-words")
    known = vocabulary(words)
    model = fit(train_part, known)

    kind = dict(rows.dtypes)["doc_id"]
    scored = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _score(known, model), f"row long, word long, times long, doc_id {kind}, n_tokens long, n_known long, logs double, model double"
    )
    rare = words.filter(F.col("n") * FREQUENT < F.lit(known.total)).select("word", F.col("n").alias("c"))
    joined = scored.join(rare, "word", "left")
    word = F.col("n_tokens").isNull()
    logs = F.when(word, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).otherwise(F.col("logs"))
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(word, F.when(F.col("c") > 0, F.col("times")).otherwise(0)).otherwise(F.col("n_known"))).cast("bigint").alias("n_known"),
        F.sum(logs).alias("logs"), F.sum(F.when(word, logs).otherwise(F.col("model"))).alias("model"),
    )
    # Each token's denominator in the base.
    per_token = float(np.log10(known.total + known.distinct + 1))
    return sums.select(
        "doc_id", (bucket_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
        F.lit(known.total).cast("bigint").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * per_token).alias("base_score"),
        F.col("model").alias("score"),
    )
