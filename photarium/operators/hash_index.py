"""Bitmaps of hashed files: which ids have a hash of which name, in blocks of 32,768 ids.

File ids are consecutive (``operators.numbering``), so a block's bitmap of 4 KB tells of 32,768 files,
and the index of an algorithm over a billion files takes 125 MB, however long the log of its hashes
is. Work-lists and coverage join files to blocks and test a bit; the log of hashes is not read.

An index is built from a log once and kept up to date by merging that of the rows appended since. Both
are aggregates with partial results: a task passes on one bitmap per name and block it saw. A log is
written in the order files were scanned, so a task sees few blocks; ids dealt out at random cost up to
4 KB per block and task. Rows with a NULL id or name say nothing and are left out, values do not
matter (a NULL hash counts as hashed, as in ``worklist.needing_hash``), repeats set the same bit.
Ids may be 0 or negative: Spark's blocks go below zero with them. An empty log gives an empty index,
by which no file is hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.operators.algorithms import ALGORITHMS, Algorithm, algorithm
from photarium.operators.latest import active, of_type
from photarium.operators.worklist import WORK

BLOCK = "block"


def build(hashes: DataFrame) -> DataFrame:
    """(hash_name, block, files): the bitmap of each block of ids that has a hash of that name."""
    rows = hashes.filter(F.col("file_id").isNotNull() & F.col("hash_name").isNotNull())
    return rows.groupBy("hash_name", F.bitmap_bucket_number("file_id").alias(BLOCK)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("file_id")).alias("files")
    )


def merge(index: DataFrame, *others: DataFrame) -> DataFrame:
    """The index of all rows that any of the given ones was built from."""
    for other in others:
        index = index.unionByName(other)
    return index.groupBy("hash_name", BLOCK).agg(F.bitmap_or_agg("files").alias("files"))


def has(files: Column, file_id: Column) -> Column:
    """Is the id's bit set in the bitmap of its block? FALSE without a bitmap."""
    position = F.bitmap_bit_position(file_id)
    byte = F.ascii(F.decode(F.substring(files, (F.floor(position / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    bit = F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1))
    return F.coalesce(bit == 1, F.lit(False))


def needing_hash(files: DataFrame, index: DataFrame, hash_name: str, file_type: str | None = None) -> DataFrame:
    """The rows of ``worklist.needing_hash``, from the index in place of the log."""
    algorithm(hash_name)
    present = active(files)
    if file_type is not None:
        present = of_type(present, file_type)
    present = present.select(*WORK, F.bitmap_bucket_number("id").alias(BLOCK))
    blocks = index.filter(F.col("hash_name") == hash_name).select(BLOCK, "files")
    return present.join(blocks, BLOCK, "left").filter(~has(F.col("files"), F.col("id"))).select(*WORK)


def hash_coverage(files: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of ``worklist.hash_coverage``, by counting bits: no join of single files.

    Present files become bitmaps themselves, by type; what an algorithm has done is what it shares
    with those it applies to, counted as a + b - (a or b).
    """
    types = {entry.file_type for entry in ALGORITHMS.values()}
    present = active(files).select(
        F.bitmap_bucket_number("id").alias(BLOCK), F.bitmap_bit_position("id").alias("at"), "file_type"
    )

    def label(file_type: str | None) -> str:
        return file_type or "any"

    blocks = present.groupBy(BLOCK).agg(*[
        F.bitmap_construct_agg("at" if t is None else F.when(F.col("file_type") == t, F.col("at"))).alias(label(t))
        for t in types
    ])
    names = F.inline(F.array(*[
        F.struct(F.lit(e.name).alias("hash_name"), F.col(label(e.file_type)).alias("wanted")) for e in ALGORITHMS.values()
    ]))
    pairs = blocks.select(BLOCK, names).join(index, ["hash_name", BLOCK], "left")
    # A pair of bitmaps is united as two rows of one group; its parts are counted beside.
    parts = pairs.select(
        "hash_name", BLOCK, F.explode(F.array(F.struct(F.col("wanted").alias("bits"), F.lit(True).alias("own")),
                                              F.struct(F.col("files").alias("bits"), F.lit(False).alias("own")))).alias("p")
    ).filter(F.col("p.bits").isNotNull())
    counted = parts.groupBy("hash_name", BLOCK).agg(
        F.sum(F.bitmap_count("p.bits")).alias("both"), F.bitmap_count(F.bitmap_or_agg("p.bits")).alias("either"),
        F.sum(F.when(F.col("p.own"), F.bitmap_count("p.bits")).otherwise(0)).alias("total"),
    ).groupBy("hash_name").agg(F.sum("total").alias("total"), F.sum(F.col("both") - F.col("either")).alias("done"))
    return _with_all_names(counted)


def _with_all_names(counted: DataFrame) -> DataFrame:
    """One row per registered algorithm, from its counts where it has any."""
    def count(entry: Algorithm, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("hash_name") == entry.name, F.col(column))), F.lit(0))

    totals = counted.agg(*[count(e, c).alias(f"{c}_{e.name}") for e in ALGORITHMS.values() for c in ("total", "done")])
    rows = [
        F.struct(
            F.lit(name).alias("hash_name"), F.col(f"total_{name}").alias("files_total"),
            F.col(f"done_{name}").alias("files_hashed"), (F.col(f"total_{name}") - F.col(f"done_{name}")).alias("files_remaining"),
        )
        for name in ALGORITHMS
    ]
    return totals.select(F.inline(F.array(*rows)))
