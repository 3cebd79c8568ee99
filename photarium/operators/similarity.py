"""Comparing perceptual fingerprints: of given pairs, of queries against all files, in clusters."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.functions import bits
from photarium.operators.components import components
from photarium.operators.latest import latest_hashes
from photarium.operators.lookup import lookup
from photarium.session import settle

# A fingerprint is indexed by its parts of so many bits.
CHUNK_BITS, CHUNKS = 16, 4
# Prints with one chunk value from which they are dealt out; each meets every probe of the value.
HOT_CHUNK = 20_000


def compare_pairs(pairs: DataFrame, hashes: DataFrame, hash_name: str) -> DataFrame:
    """(left_id, right_id, distance, verdict) for given pairs (left_id, right_id).

    Uses each file's newest ``hash_name``; pairs without both fingerprints are left out, and
    a pair given several times is compared once.
    Work grows with the number of pairs given, not with its square, and a file that takes
    part in very many pairs is spread over tasks.
    """
    prints = latest_hashes(hashes, hash_name).select("file_id", bits.from_text(F.col("hash_value")).alias("print"))
    left = prints.select(F.col("file_id").alias("left_id"), F.col("print").alias("_left"))
    right = prints.select(F.col("file_id").alias("right_id"), F.col("print").alias("_right"))
    distance = bits.hamming(F.col("_left"), F.col("_right"))
    return (
        lookup(lookup(pairs.select("left_id", "right_id").distinct(), left, "left_id"), right, "right_id")
        .filter(F.col("_left").isNotNull() & F.col("_right").isNotNull())
        .select("left_id", "right_id", distance.alias("distance"), bits.same_picture(distance).alias("verdict"))
    )


def near_copies(pairs: DataFrame, hashes: DataFrame, hash_name: str) -> DataFrame:
    """Those of the given pairs that are likely the same picture."""
    return compare_pairs(pairs, hashes, hash_name).filter(F.col("distance") < bits.SAME_PICTURE_BELOW)


def clusters(pairs: DataFrame) -> DataFrame:
    """(file_id, cluster_id) of the files in ``pairs`` (left_id, right_id), such as near copies.

    A cluster is all that pairs connect, over any number of steps; its id is its smallest file.
    """
    return components(pairs).select(F.col("id").alias("file_id"), F.col("root").alias("cluster_id"))


def print_classes(prints: DataFrame) -> DataFrame:
    """(file_id, class_id): files with the same ``print`` are one class, known by its smallest file.

    A print that very many files share is a hot key of the join back, and dealt out.
    """
    known = prints.filter(F.col("print").isNotNull()).select("file_id", "print")
    classes = known.groupBy("print").agg(F.min("file_id").alias("class_id"))
    return lookup(known, classes, "print").select("file_id", "class_id")


def _chunk(value: Column, chunk: int) -> Column:
    return F.shiftright(value, chunk * CHUNK_BITS).bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("int")


def radii(below: int) -> list[int]:
    """Per chunk, how many bits a probe may flip so that no pair nearer than ``below`` is missed.

    If every chunk differed in more bits than its radius, the whole would differ in at least the sum
    of the radii plus one each; these sums are ``below``. A radius of -1 leaves a chunk out.
    """
    each, rest = divmod(below, CHUNKS)
    return [each + (i < rest) - 1 for i in range(CHUNKS)]


def _masks(radius: int) -> list[int]:
    """All numbers of a chunk with at most ``radius`` bits."""
    return [sum(1 << b for b in chosen) for n in range(radius + 1) for chosen in combinations(range(CHUNK_BITS), n)]


def candidates(queries: DataFrame, classes: DataFrame, below: int, hot_rows: int = HOT_CHUNK) -> DataFrame:
    """Pairs (query_print, print, first) that agree in a chunk up to its radius; ``first`` marks one row of each pair.

    ``classes`` has every print once and is indexed by its chunks; ``queries`` has prints to look for,
    each once, and probes all values near each of its chunks. The entries of a chunk value that very
    many prints share are dealt out over tasks and meet the probes of it in each.
    """
    allowed = radii(below)
    used = [i for i in range(CHUNKS) if allowed[i] >= 0]
    entry = lambda print_, i: F.struct(F.lit(i).alias("chunk"), _chunk(print_, i).alias("value"))
    index = classes.select("print", F.explode(F.array(*[entry(F.col("print"), i) for i in used])).alias("_e")).select(
        "print", (F.col("_e.chunk") * (1 << CHUNK_BITS) + F.col("_e.value")).alias("slot")
    )

    def near_values(i: int) -> Column:
        masks = F.array(*map(F.lit, _masks(allowed[i])))
        return F.transform(masks, lambda mask: F.lit(i * (1 << CHUNK_BITS)) + _chunk(F.col("print"), i).bitwiseXOR(mask))

    probes = queries.select(
        F.col("print").alias("query_print"), F.explode(F.concat(*map(near_values, used))).alias("slot")
    )
    met = lookup(index, probes, "slot", hot_rows)
    # A pair that agrees in several chunks counts in the first of them, so nothing is sorted out later.
    apart = F.col("query_print").bitwiseXOR(F.col("print"))
    chunk = F.shiftright("slot", CHUNK_BITS)
    first = F.lit(True)
    for i in used:
        first = first & ((chunk <= i) | (F.bit_count(_chunk(apart, i)) > allowed[i]))
    return met.select("query_print", "print", first.alias("first"))


def search(prints: DataFrame, is_query: Column, below: int = bits.SAME_PICTURE_BELOW, hot_rows: int = HOT_CHUNK) -> DataFrame:
    """(query_id, match_id, distance, queries, matches): all pairs of classes nearer than ``below``.

    ``prints`` has ``file_id`` and ``print``; files with ``is_query`` are looked for among all, their own
    class included. Files with equal prints are one class, so copies meet once however many they are:
    ``query_id`` and ``match_id`` are the smallest query file and the smallest file of the two classes,
    ``queries`` and ``matches`` the numbers of files, and ``print_classes`` tells which. Exact for every
    ``below``; the work grows with the probes, which ``radii`` keeps few up to about 12. Files without
    a print are not found.
    """
    known = prints.filter(F.col("print").isNotNull()).select("file_id", "print", F.coalesce(is_query, F.lit(False)).alias("_query"))
    classes = settle(
        known.groupBy("print").agg(
            F.min("file_id").alias("match_id"), F.count(F.lit(1)).alias("matches"),
            F.min(F.when(F.col("_query"), F.col("file_id"))).alias("query_id"), F.count_if("_query").alias("queries"),
        ), "print-classes",
    )
    asked = classes.filter(F.col("queries") > 0).select("print", "query_id", "queries")
    distance = bits.hamming(F.col("query_print"), F.col("print"))
    near = candidates(asked, classes.select("print"), below, hot_rows).filter(F.col("first") & (distance < below))
    # A class that is near very many others is a hot key on either side.
    with_query = lookup(near.select("query_print", "print", distance.alias("distance")), asked.withColumnRenamed("print", "query_print"), "query_print")
    return lookup(with_query, classes.select("print", "match_id", "matches"), "print").select("query_id", "match_id", "distance", "queries", "matches")
