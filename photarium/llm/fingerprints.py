"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph (a line) is hashed to a wide vector of two parts, and a document's fingerprint is
the sum of its paragraphs' vectors, each number modulo a power of two:

* ``DENSE`` numbers modulo 2^62, hashed from the paragraph as a whole;
* ``LANES`` counters modulo 2^20, three to a 64-bit word, which add up the hash bits of the
  paragraph's sentences, and one more word that counts the sentences.

So the order of paragraphs does not matter, and a paragraph is put in or taken out by adding
or subtracting its vector. The counters keep likeness: read as sums of +1 and -1, their cosine
estimates how many sentences two documents share, whatever their length.

All of it is column expressions: each text is hashed where it is read. Nulls and repeats: a
null text counts as empty; an empty text has one empty paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.llm.common import settle
from photarium.operators.numbering import number_rows

DENSE = 4
# Two hashes of 63 bits: 2 x 21 words of three counters.
HASHES = 2
WORDS = 21
LANES = HASHES * WORDS * 3
_DENSE_MASK = (1 << 62) - 1
_BITS = 1 | 1 << 21 | 1 << 42
_LANE = (1 << 20) - 1
_LANES_MASK = _LANE * _BITS


def _text(text: str) -> str:
    return f"coalesce({text}, '')"


def vector(text: str) -> Column:
    """The fingerprint of the text in column ``text`` as an array of bigint: dense part, count, counters."""
    dense = (
        f"aggregate(split({_text(text)}, '\\n', -1), array_repeat(0L, {DENSE}), (acc, line) -> "
        f"transform(acc, (a, i) -> (a + (xxhash64(line, i) & {_DENSE_MASK}L)) & {_DENSE_MASK}L))"
    )
    # Sentences with their end marks, the last one of a line with the line end; blanks count as nothing here.
    pieces = (
        f"filter(split(concat({_text(text)}, '\\n'), '(?<=[.!?])(?= )|(?<=\\n)', -1), "
        "p -> trim(BOTH ' \t\r\n' FROM p) != '')"
    )
    counters = ", ".join(
        f"aggregate(transform({pieces}, p -> xxhash64(p, {100 + h})), array_repeat(0L, {WORDS}), (acc, x) -> "
        f"transform(acc, (a, i) -> (a + (shiftrightunsigned(x, i) & {_BITS}L)) & {_LANES_MASK}L))"
        for h in range(HASHES)
    )
    return F.expr(f"concat({dense}, array(cast(size({pieces}) as bigint)), {counters})")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two multisets put together (``sign`` 1), or of ``a`` without ``b`` (-1)."""

    def place(i: Column) -> Column:
        x, y = F.element_at(a, i), F.element_at(b, i)
        if sign < 0:  # the complement within each counter
            y = F.when(i <= DENSE, F.lit(1 << 62) - y).when(i == DENSE + 1, -y).otherwise(F.lit((_LANE + 1) * _BITS) - y)
        return F.when(i <= DENSE, (x + y).bitwiseAND(F.lit(_DENSE_MASK))).when(i == DENSE + 1, x + y).otherwise(
            (x + y).bitwiseAND(F.lit(_LANES_MASK))
        )

    return F.transform(F.sequence(F.lit(1), F.lit(DENSE + 1 + HASHES * WORDS)), place)


def hexadecimal(v: Column) -> Column:
    """A vector as text."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _signed(v: str) -> str:
    """The counters of vector ``v`` as sums of +1 and -1."""
    lanes = f"slice({v}, {DENSE + 2}, {HASHES * WORDS})"
    one = f"(2D * (shiftrightunsigned(w, s) & {_LANE}L) - element_at({v}, {DENSE + 1}))"
    return f"flatten(transform({lanes}, w -> transform(array(0, 21, 42), s -> {one})))"


def likeness(a: str, b: str) -> Column:
    """Likeness of the fingerprints in columns ``a`` and ``b``: 1 if equal, near 0 if nothing is shared."""
    total = "aggregate({}, 0D, (acc, x) -> acc + x)"
    dot = total.format(f"zip_with({_signed(a)}, {_signed(b)}, (x, y) -> x * y)")
    square = "sqrt(" + total.format("transform({}, x -> x * x)") + ")"
    cosine = F.expr(f"try_divide({dot}, {square.format(_signed(a))} * {square.format(_signed(b))})")
    return F.when(F.expr(f"{a} = {b}"), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` and the array ``fingerprint``."""
    given = [F.col(f"`{c}`") for c in docs.columns if c not in {"n_chars", "fingerprint"}]
    return docs.select(
        *given, F.expr(f"cast(char_length({_text('text')}) as bigint)").alias("n_chars"), vector("text").alias("fingerprint")
    )


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, whose end is that of the next document's start.

    The next document has the next smaller id (null is the smallest); after the last comes the
    first. Of rows with one id, the one with the smallest start stands for it as a next document.
    Ids are put in order without their texts; texts are dealt by id once, for both joins.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("_most"))
    ordered = settle(
        number_rows(sizes.withColumn("_order", F.struct(F.col("doc_id").isNull().alias("n"), (-F.col("doc_id")).alias("d"))), ["_order"], 0, "_seq")
        .select("doc_id", "_most", "_seq"), "fingerprint-order",
    )
    following = ordered.select(F.col("doc_id").alias("_next"), F.col("_seq").alias("_at"))
    behind = F.when(F.col("_seq") == ordered.count(), F.lit(1)).otherwise(F.col("_seq") + 1)
    pairs = ordered.withColumn("_at", behind).join(following, "_at").select(
        F.col("doc_id").alias("_owner"), "_next", F.floor(F.col("_most") / 3).cast("int").alias("_need")
    )
    starts = texts.join(pairs, F.col("doc_id").eqNullSafe(F.col("_next"))).select(
        "_owner", F.expr("left(text, _need)").alias("start"), vector("text").alias("next")
    ).groupBy("_owner").agg(F.min(F.struct("start", "next")).alias("_after"))
    joined = texts.join(starts, F.col("doc_id").eqNullSafe(F.col("_owner"))).withColumn(
        "_cut", F.expr("cast(floor(char_length(text) / 3) as int)")
    )
    both = joined.select(
        "doc_id", F.expr("cast(char_length(text) as bigint)").alias("n_chars"), vector("text").alias("own"),
        F.expr("concat(left(text, char_length(text) - _cut), left(_after.start, _cut))").alias("edited"), F.col("_after.next").alias("next"),
    )
    return both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", vector("edited").alias("changed"), "next")


def digest(docs: DataFrame) -> DataFrame:
    """The fingerprints of ``edits`` as text, with the likeness to the edited and to the next text."""
    return edits(docs).select(
        "doc_id", "n_chars", "edited_sha256", hexadecimal(F.col("own")).alias("fingerprint"),
        hexadecimal(F.col("changed")).alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )
