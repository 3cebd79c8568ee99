"""Mix sources to target weights by weighted sampling without replacement.

Each document draws an exponential key divided by its quality weight (Efraimidis and
Spirakis): sorted by key, a source's documents are a weighted random order. A source's
target is served by complete epochs first; what is left is the front of that order, cut
where the running sum of sizes comes nearest to it.

No task holds a source. Keys fall into buckets that hold a bounded number of documents on
average; the running sums are those of the buckets before plus those within one bucket. The
result of this is one cut key per source, and every document is compared with the cut of its
source, so texts are never shuffled.

Nulls and repeats: a null text has size 0, a null source is a source of its own and comes
last, null ids are ordinary values. Rows alike in id and text draw one key and are taken
together, and so are documents with equal keys. Very long texts are counted whole. An empty table gives
an empty result. Given columns may have any name; the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photarium.llm.common import WORD, settle, unit

SEED = 11
# Documents per bucket of the running sum, on average.
BUCKET_ROWS = 50_000
# No source is repeated more often than this.
MOST_EPOCHS = 3
# Weights of the sources in the order of their names, repeating.
SOURCE_WEIGHTS = (1, 2, 3)
# Quality weight of texts that do not look like prose; prose has 1.
LEAST_QUALITY = 0.25


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality(text: Column, words: Column) -> Column:
    """Quality weight of a text: 1 if its mean word length is that of prose, else less."""
    mean = F.coalesce(F.char_length(text), F.lit(0)) / F.greatest(words, F.lit(1))
    return F.when(mean.between(3, 11), F.lit(1.0)).otherwise(F.lit(LEAST_QUALITY))


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``_size`` and the sampling key ``_key``."""
    sized = docs.withColumn("_size", words_in(F.col("text")))
    key = -F.log(unit(F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), seed=seed))
    return sized.withColumn("_key", key / quality(F.col("text"), F.col("_size")))


def targets(facts: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: ``source_size``, ``rows``, ``target``.

    Targets share the total by weight; a source cannot get more than ``most`` times its size,
    and what it leaves is shared by the others. With sources sorted by size over weight, the
    capped ones come first, so one running sum finds the common rate. The windows run over
    distinct sources only.
    """
    named = facts.groupBy("source").agg(
        F.sum("_size").cast("bigint").alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    listed = named.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rated = listed.withColumn("_rate", left.cast("double") / share.cast("double"))
    # The rate that holds is that of the first source which is not capped at its own rate.
    own = F.when(
        F.col("_rate") * F.col("weight") <= F.col("cap"),
        F.struct(F.row_number().over(order).alias("at"), F.col("_rate").alias("rate")),
    )
    found = rated.withColumn("_own", own).withColumn("_found", F.min("_own").over(everything)["rate"])
    target = F.least(F.col("cap").cast("double"), F.col("_found") * F.col("weight"))
    return found.select("source", "source_size", "rows", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def cuts(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with ``epochs`` and ``cut``: documents with smaller keys are taken once more.

    With ``behind``, so is the one at the cut.
    """
    planned = sources.withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"),
        "_buckets": F.ceil(F.col("rows") / BUCKET_ROWS).cast("bigint"),
    }).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # A key is exponential with a rate from LEAST_QUALITY to 1, so this spreads keys over (0, 1) with
    # at most 1 / LEAST_QUALITY times the average in a bucket.
    bucket = F.floor((1 - F.exp(-F.col("_key") * LEAST_QUALITY)) * F.col("_buckets")).cast("bigint")
    placed = facts.join(planned.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_bucket", bucket)
    sums = placed.groupBy("_s", "_bucket").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    # Only the bucket in which a source reaches its budget has to be sorted.
    reached = placed.join(
        starts.select(F.col("_s").alias("_t"), F.col("_bucket").alias("_b"), "_start", "_sum"),
        F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_bucket") == F.col("_b")),
    ).filter((F.col("_start") <= F.col("_rest")) & (F.col("_rest") <= F.col("_start") + F.col("_sum")))
    upto = Window.partitionBy("_s", "_bucket").orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)
    running = reached.withColumn("_upto", F.col("_start") + F.sum("_size").over(upto))
    # Cut behind the key whose sum is nearest to the budget, or before the bucket if that is nearer.
    near = F.min(F.struct(F.abs(F.col("_upto") - F.col("_rest")).alias("off"), F.col("_key").alias("key")))
    cut = running.groupBy("_s").agg(
        near.alias("_near"), F.min("_key").alias("_least"), (F.first("_rest") - F.min("_start")).alias("_low")
    )
    behind = F.col("_near.off") < F.col("_low")
    cut = cut.select(
        F.col("_s").alias("_c"), F.when(behind, F.col("_near.key")).otherwise(F.col("_least")).alias("cut"), behind.alias("behind")
    )
    return planned.join(cut, F.col("source").eqNullSafe(F.col("_c")), "left").select(
        "source", "source_size", "target", "epochs", "cut", "behind"
    )


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` (0 to 3) and ``taken``.

    ``copies`` says how often the mix takes a document, ``taken`` how many words that is.
    """
    added = {"size", "source_size", "target", "copies", "taken"}
    given = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_given")
    rows = keyed(docs.select(given, "doc_id", "text", "source"), seed)
    facts = settle(rows.select("source", "_size", "_key"), "mix-facts")
    plan = settle(cuts(facts, settle(targets(facts), "mix-sources")), "mix-cuts")
    plan = plan.select(*(F.col(c).alias(f"_{c}") for c in plan.columns))
    chosen = (F.col("_key") < F.col("_cut")) | (F.col("_behind") & (F.col("_key") == F.col("_cut")))
    copies = (F.col("_epochs") + F.when(chosen, 1).otherwise(0)).cast("int")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select(
        *(F.col(f"_given.`{c}`") for c in docs.columns if c not in added),
        F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        copies.alias("copies"), (copies * F.col("_size")).cast("bigint").alias("taken"),
    )


def repeated(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    mixed = mix(docs.select("doc_id", "text", "source", row), seed)
    copies = mixed.filter(F.col("copies") > 0).select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return copies.select("_row.*")
