"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.functions import bits, paths
from photarium.operators import fingerprints, hash_index, hashing, latest, metadata, observe, reports, similarity, versions, worklist
from photarium.operators.algorithms import algorithm
from photarium.plans import runs, scans
from photarium.registry import adapters as a
from photarium.session import scratch_path, settle
from photarium.sources import media
from photarium.streaming import first_hash, latest_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _library_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.files_view(a.library_master(spark, sf_dir), a.library_stats(spark, sf_dir))


def _tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.files_view(a.tree_master(spark, sf_dir), a.tree_stats(spark, sf_dir))


# --- listings and path columns ---------------------------------------------------------


@query
def inventory_scan(spark, sf_dir):
    """A full listing: every file under each of its roots."""
    return a.full_listing(spark, sf_dir)


@query
def path_parts(spark, sf_dir):
    """Name and extension of every path, separator and home-folder forms of it."""
    both = a.table(spark, sf_dir, "documents").select(a.document_path().alias("path")).unionByName(
        a.table(spark, sf_dir, "pages").select(a.page_path().alias("path"))
    )
    windows = F.concat(F.lit("D:"), F.translate("path", "/", "\\"))
    return both.select(
        "path",
        paths.filename(F.col("path")).alias("filename"),
        paths.extension(F.col("path")).alias("extension"),
        paths.forward_slashes(windows).alias("from_windows"),
        paths.expand_home(F.concat(F.lit("~"), F.col("path")), "/home/me").alias("from_home"),
    )


@query
def mtime_split(spark, sf_dir):
    """Event times as mtimes; errors moved to before the epoch."""
    moved = F.when(F.col("event_type") == "error", F.col("ts") - F.expr("INTERVAL 60 YEAR")).otherwise(F.col("ts"))
    moment = moved.cast("timestamp")
    return a.table(spark, sf_dir, "events").select(
        "event_id", paths.mtime_seconds(moment).alias("mtime_secs"), paths.mtime_nanos(moment).alias("mtime_nanos")
    )


@query
def classify_files(spark, sf_dir):
    """File type of every listed file."""
    return observe.describe(a.full_listing(spark, sf_dir)).select("root_dir", "path", "extension", "file_type")


# --- statistics ------------------------------------------------------------------------


@query
def scan_stats(spark, sf_dir):
    """Totals of one scan by type."""
    return reports.scan_stats(observe.describe(a.full_listing(spark, sf_dir)))


@query
def library_stats(spark, sf_dir):
    """Totals of the present files."""
    return reports.library_stats(latest.latest_stats(a.library_stats(spark, sf_dir)))


# --- latest state ----------------------------------------------------------------------


@query
def v_files(spark, sf_dir):
    """Every file with its latest observation."""
    return _library_files(spark, sf_dir)


@query
def v_file_hashes(spark, sf_dir):
    """Latest hash per file and algorithm."""
    return latest.latest_hashes(a.library_hashes(spark, sf_dir))


@query
def v_file_metadata(spark, sf_dir):
    """Latest value per file and tag."""
    return latest.latest_metadata(a.library_metadata(spark, sf_dir))


@query
def latest_stat_id(spark, sf_dir):
    """Latest observation id per file."""
    return latest.latest_stat_ids(a.library_stats(spark, sf_dir))


@query
def file_history(spark, sf_dir):
    """All observations in order."""
    return latest.file_history(a.library_stats(spark, sf_dir)).select(
        "file_id", "observed_at", "stat_id", "root_dir", "size_bytes", "is_missing"
    )


@query
def file_versions(spark, sf_dir):
    """Stretches of observations in which a file stays where it is and is there or missing."""
    return versions.file_versions(a.library_stats(spark, sf_dir), ["root_dir", "is_missing"])


@query
def active_files(spark, sf_dir):
    """Files present at their latest observation."""
    return latest.active(_library_files(spark, sf_dir)).select("id", "path", "file_type", "size_bytes")


@query
def active_files_for_root(spark, sf_dir):
    """Present files of one root."""
    return latest.active_in_root(_library_files(spark, sf_dir), "/vol/2")


@query
def known_paths(spark, sf_dir):
    """Present paths by root."""
    return latest.known_paths(_library_files(spark, sf_dir))


@query
def file_exists(spark, sf_dir):
    """Which listed paths are already catalogued."""
    return latest.file_exists(a.second_listing(spark, sf_dir), a.tree_master(spark, sf_dir))


# --- recording a scan ------------------------------------------------------------------


@query
def assign_file_ids(spark, sf_dir):
    """Identities for newly listed paths."""
    return observe.new_files(a.second_listing(spark, sf_dir), a.tree_master(spark, sf_dir))


@query
def append_observations(spark, sf_dir):
    """Observation rows of a full scan, whose new paths have got their identities."""
    described = observe.describe(a.full_listing(spark, sf_dir))
    master = a.tree_master(spark, sf_dir)
    known = master.unionByName(observe.new_files(described, master).select(*master.columns))
    return observe.observations(described, known, a.tree_stats(spark, sf_dir), a.at(a.SECOND_SCAN))


@query
def missing_paths(spark, sf_dir):
    """Known paths the second scan did not see."""
    known = latest.known_paths(_tree_files(spark, sf_dir))
    return observe.missing_paths(known, a.second_listing(spark, sf_dir), a.TREE_ROOTS).select("root_dir", "path")


@query
def mark_missing(spark, sf_dir):
    """Carry-forward rows for paths without a label, some of them unknown."""
    labels = a.table(spark, sf_dir, "labels")
    gone = (
        a.table(spark, sf_dir, "documents").join(labels, "doc_id", "left_anti").select(a.document_path().alias("path"))
        .unionByName(a.table(spark, sf_dir, "pages").select(a.page_path().alias("path")))
    )
    return observe.mark_missing(
        gone, a.tree_master(spark, sf_dir), a.tree_stats(spark, sf_dir), a.at(a.SECOND_SCAN)
    )


@query
def change_detection(spark, sf_dir):
    """State of every path between the scans."""
    return observe.changes(a.second_listing(spark, sf_dir), _tree_files(spark, sf_dir))


@query
def scan_cycle(spark, sf_dir):
    """All rows the second scan appends to the observation log."""
    output = scans.library_scan(
        settle(a.second_listing(spark, sf_dir), "listing"), a.TREE_ROOTS, a.tree_master(spark, sf_dir), a.tree_stats(spark, sf_dir),
        a.at(a.SECOND_SCAN),
    )
    return output.new_stats


# --- work-lists ------------------------------------------------------------------------


@query
def needing_hash_blake3(spark, sf_dir):
    """Present files without a full digest, smallest first."""
    work = worklist.needing_hash(_library_files(spark, sf_dir), a.library_hashes(spark, sf_dir), "blake3")
    return worklist.smallest_first(work.select("id", "path", "size_bytes"))


@query
def needing_hash_images(spark, sf_dir):
    """Present images without a mean hash."""
    work = worklist.needing_hash(_library_files(spark, sf_dir), a.library_hashes(spark, sf_dir), "phash", "image")
    return work.select("id", "path", "size_bytes")


@query
def needing_hash_stale_aware(spark, sf_dir):
    """Present files without a full digest of their present version."""
    work = worklist.needing_hash_or_stale(
        _library_files(spark, sf_dir), a.library_stats(spark, sf_dir), a.library_hashes(spark, sf_dir), "blake3"
    )
    return work.select("id", "path", "size_bytes")


@query
def needing_metadata(spark, sf_dir):
    """Present images and videos without tags."""
    work = worklist.needing_metadata(_library_files(spark, sf_dir), a.library_metadata(spark, sf_dir))
    return work.select("id", "path", "file_type")


@query
def hash_coverage(spark, sf_dir):
    """Done and remaining files per algorithm."""
    return worklist.hash_coverage(_library_files(spark, sf_dir), a.library_hashes(spark, sf_dir))


@query
def needing_hash_indexed(spark, sf_dir):
    """Present files without a full digest, from bitmaps of the hashed files."""
    index = settle(hash_index.build(a.library_hashes(spark, sf_dir)), "hash-index")
    work = hash_index.needing_hash(_library_files(spark, sf_dir), index, "blake3")
    return work.select("id", "path", "size_bytes")


@query
def hash_coverage_indexed(spark, sf_dir):
    """Done and remaining files per algorithm, by counting bits of the bitmaps."""
    index = settle(hash_index.build(a.library_hashes(spark, sf_dir)), "hash-index")
    return hash_index.hash_coverage(_library_files(spark, sf_dir), index)


# --- hashes ----------------------------------------------------------------------------


@query
def full_digest(spark, sf_dir):
    """Digest of every document's bytes."""
    return hashing.compute(a.tree_contents(spark, sf_dir), "blake3").select("file_id", "hash_name", "hash_value")


# Leaves and groups small enough for documents to have trees of several levels.
TREE_LEAF_BYTES, TREE_FAN = 256, 8


@query
def tree_digest(spark, sf_dir):
    """Tree digest of every document's bytes."""
    contents = a.tree_contents(spark, sf_dir)
    return fingerprints.tree_digest(contents, "file_id", "content", TREE_LEAF_BYTES, TREE_FAN)


@query
def content_digest(spark, sf_dir):
    """Digest of every picture's pixels."""
    pixels = a.pictures(spark, sf_dir).select("file_id", media.rgba_bytes("image").alias("content"))
    return hashing.compute(pixels, "content_blake3").select("file_id", "hash_name", "hash_value")


@query
def hash_scan_blake3(spark, sf_dir):
    """Hash rows a full-digest scan appends: work-list, contents, digests, stamp."""
    master, stats = a.tree_master(spark, sf_dir), a.tree_stats(spark, sf_dir)
    work = scans.hash_work(master, stats, a.tree_hashes(spark, sf_dir), "blake3").select(F.col("id").alias("file_id"))
    # Digests next to the scan; only they meet the work-list.
    results = hashing.compute(a.tree_contents(spark, sf_dir), "blake3").join(work, "file_id")
    return scans.hash_scan(results, stats, a.at(a.SECOND_SCAN)).new_hashes


@query
def append_hashes(spark, sf_dir):
    """Fingerprints stored as decimal text, stamped with the latest observation."""
    values = a.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("file_id"),
        F.lit("phash").alias("hash_name"),
        bits.to_text(a.cents("c_acctbal") * F.lit(90_000_000_007)).alias("hash_value"),
    )
    return scans.hash_scan(values, a.library_stats(spark, sf_dir), a.at(a.SECOND_SCAN)).new_hashes


def _named_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose names come from outside; one of them is not registered."""
    return a.library_metadata(spark, sf_dir).select(
        "stat_id",
        F.element_at(
            F.create_map(*[F.lit(x) for pair in zip(a.NAMESPACES.values(), [*a.HASH_NAMES[:4], "sha256"]) for x in pair]),
            F.col("namespace"),
        ).alias("hash_name"),
        F.col("value").alias("hash_value"),
    )


@query
def validate_hash_names(spark, sf_dir):
    """Every result with the error its name gives it, if any."""
    return hashing.check_names(_named_results(spark, sf_dir)).select(
        "stat_id", "hash_name", "hash_value", "error_code", "error_message"
    )


@query
def hash_quarantine(spark, sf_dir):
    """Pictures that could not be hashed: those exported once have no readable pixels."""
    damaged = a.pictures(spark, sf_dir).join(
        a.table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 100).alias("file_id"), "label"), "file_id", "left"
    )
    pixels = damaged.select(
        "file_id", F.when(F.coalesce("label", F.lit(1)) != 0, media.rgba_bytes("image")).alias("content")
    )
    return hashing.quarantine(hashing.compute(pixels, "content_blake3"))


# --- duplicates ------------------------------------------------------------------------


@query
def dupes_blake3(spark, sf_dir):
    """Largest groups of byte-identical present documents."""
    contents = a.tree_contents(spark, sf_dir)
    log = hashing.compute(contents, "blake3").select(
        "file_id", F.col("file_id").alias("stat_id"), "hash_name", "hash_value", a.at(a.FIRST_SCAN).alias("computed_at")
    )
    return reports.duplicates_report(log, a.tree_stats(spark, sf_dir), "blake3")


@query
def dupes_content(spark, sf_dir):
    """Largest groups of pictures with the same pixels."""
    pixels = a.pictures(spark, sf_dir).select("file_id", media.rgba_bytes("image").alias("content"))
    log = hashing.compute(pixels, "content_blake3").select(
        "file_id", F.col("file_id").alias("stat_id"), "hash_name", "hash_value", a.at(a.FIRST_SCAN).alias("computed_at")
    )
    return reports.duplicates_report(log, a.picture_stats(spark, sf_dir), "content_blake3")


@query
def dupe_members(spark, sf_dir):
    """All present documents that share their bytes with others, and which of each group to keep."""
    log = hashing.compute(a.tree_contents(spark, sf_dir), "blake3").select(
        "file_id", F.col("file_id").alias("stat_id"), "hash_name", "hash_value", a.at(a.FIRST_SCAN).alias("computed_at")
    )
    return reports.duplicate_members(log, _tree_files(spark, sf_dir), "blake3")


# --- metadata --------------------------------------------------------------------------


@query
def exif_normalize(spark, sf_dir):
    """Text of every typed tag."""
    return metadata.exif_rows(a.typed_tags(spark, sf_dir))


@query
def video_metadata(spark, sf_dir):
    """Format fields of every probe document."""
    return metadata.format_rows(a.probes(spark, sf_dir))


@query
def video_tags(spark, sf_dir):
    """Format tags of every probe document."""
    return metadata.format_tag_rows(a.probes(spark, sf_dir))


@query
def video_streams(spark, sf_dir):
    """Stream fields of every probe document."""
    return metadata.stream_rows(a.probes(spark, sf_dir))


@query
def metadata_dispatch(spark, sf_dir):
    """Tags of images and probes of videos, nothing for other files."""
    files = _library_files(spark, sf_dir).select(F.col("id").alias("file_id"), "file_type")
    return metadata.dispatch(files, a.typed_tags(spark, sf_dir), a.probes(spark, sf_dir))


@query
def append_metadata(spark, sf_dir):
    """Tag rows stamped with each file's latest observation."""
    stamped = metadata.stamp(a.typed_tags(spark, sf_dir), a.library_stats(spark, sf_dir))
    return metadata.log_rows(metadata.exif_rows(stamped), a.at(a.SECOND_SCAN))


@query
def metadata_scan(spark, sf_dir):
    """Tag rows a metadata scan appends for files without any."""
    return scans.metadata_scan(
        a.library_master(spark, sf_dir), a.library_stats(spark, sf_dir), a.library_metadata(spark, sf_dir),
        a.typed_tags(spark, sf_dir), a.probes(spark, sf_dir), a.at(a.SECOND_SCAN),
    )


# --- pictures --------------------------------------------------------------------------


def _grids(spark: SparkSession, sf_dir: str, width: int, height: int) -> DataFrame:
    return a.pictures(spark, sf_dir).select(
        "file_id", media.brightness_grid(width, height)("image").alias("grid")
    )


@query
def media_grid(spark, sf_dir):
    """Every picture reduced to 4 x 4 mean brightness, one row per cell."""
    grids = _grids(spark, sf_dir, 4, 4)
    return grids.select("file_id", F.posexplode("grid").alias("cell", "brightness"))


@query
def phash_mean(spark, sf_dir):
    """Mean hash of every picture."""
    value = fingerprints.mean_hash(F.col("grid"), 8, 8)
    return _grids(spark, sf_dir, 8, 8).select("file_id", value.alias("fingerprint"))


def _prints(spark: SparkSession, sf_dir: str, hash_name: str, across: int, down: int) -> DataFrame:
    """An algorithm with its own grid, on pictures whose sides its cells divide evenly."""
    method = algorithm(hash_name)
    grid = media.brightness_grid(*method.grid)("image")
    return a.pictures(spark, sf_dir, across, down).select("file_id", grid.alias("grid")).select(
        "file_id", method.compute(F.col("grid")).cast("bigint").alias("fingerprint")
    )


@query
def dhash_gradient(spark, sf_dir):
    """Gradient hash of every picture."""
    return _prints(spark, sf_dir, "dhash", 9, 8)


@query
def whash_double_gradient(spark, sf_dir):
    """Double gradient hash of every picture."""
    return _prints(spark, sf_dir, "whash", 5, 5)


def _edit_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each edited picture paired with its original, and the next original in id order."""
    edited = a.edited_pictures(spark, sf_dir)
    log = hashing.compute(
        edited.select("file_id", media.brightness_grid(8, 8)("image").alias("content")), "phash"
    ).select("file_id", F.col("file_id").alias("stat_id"), "hash_name", "hash_value", a.at(a.FIRST_SCAN).alias("computed_at"))
    left = F.col("vec_id") * 100
    with_original = edited.select(left.alias("left_id"), F.col("file_id").alias("right_id"))
    with_next = a.table(spark, sf_dir, "embeddings").select(left.alias("left_id"), (left + 100).alias("right_id"))
    return with_original.unionByName(with_next), log


@query
def hamming_pairs(spark, sf_dir):
    """Distance and verdict of given picture pairs."""
    pairs, log = _edit_pairs(spark, sf_dir)
    return similarity.compare_pairs(pairs, log, "phash")


@query
def near_dupes(spark, sf_dir):
    """Those of the given pairs that are likely the same picture."""
    pairs, log = _edit_pairs(spark, sf_dir)
    return similarity.near_copies(pairs, log, "phash").select("left_id", "right_id", "distance")


@query
def near_dupe_clusters(spark, sf_dir):
    """Clusters of pictures that the likely copies among the given pairs connect."""
    return similarity.clusters(near_dupes(spark, sf_dir))


def _edited_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean hash of every edited picture, whose copies with the same pixels have the same."""
    value = fingerprints.mean_hash(F.col("grid"), 8, 8)
    grids = a.edited_pictures(spark, sf_dir).select("file_id", media.brightness_grid(8, 8)("image").alias("grid"))
    return grids.select("file_id", value.alias("print"))


@query
def hamming_search(spark, sf_dir):
    """Pictures whose number 100 divides, against all: classes of equal prints below the distance of likely copies."""
    return similarity.search(_edited_prints(spark, sf_dir), F.col("file_id") % 100 == 0)


@query
def print_classes(spark, sf_dir):
    """The class of equal prints of every picture."""
    return similarity.print_classes(_edited_prints(spark, sf_dir))


# --- runs ------------------------------------------------------------------------------


@query
def scan_run_status(spark, sf_dir):
    """State of every run."""
    return runs.run_status(a.run_events(spark, sf_dir))


@query
def scan_progress(spark, sf_dir):
    """Every progress report with its percentage."""
    return runs.progress_snapshots(a.run_events(spark, sf_dir))


# --- streams ---------------------------------------------------------------------------


def _order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, as the table may be one file or a folder of them.
    schema = a.table(spark, sf_dir, "orders").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.parque[t]")


@query
def stream_latest_state(spark, sf_dir):
    """Latest state kept by a stream over the observation log."""
    target = scratch_path(spark, "latest")
    stream = a.observations_of(_order_stream(spark, sf_dir))
    latest_state.maintain_latest(stream, target, f"{target}-progress").awaitTermination()
    return latest_state.read_latest(spark, target)


@query
def stream_first_hash(spark, sf_dir):
    """Earliest hash row of each file and algorithm, kept by a stream over the hash log."""
    target = scratch_path(spark, "first")
    stream = a.hashes_of(_order_stream(spark, sf_dir))
    first_hash.maintain_first(stream, target, f"{target}-progress").awaitTermination()
    return first_hash.read_first(spark, target)


def _arrivals(spark: SparkSession, sf_dir: str, log: str) -> Iterator[DataFrame]:
    """The stream over a folder to which the orders of each step are added, one step after the other."""
    orders = a.table(spark, sf_dir, "orders")
    for step in range(4):
        orders.filter(a.arrival() == step).write.mode("append").parquet(log)
        yield spark.readStream.schema(orders.schema).parquet(log)


@query
def maintained_files(spark, sf_dir):
    """Every file with its latest observation, from a snapshot and the batch after it."""
    target = scratch_path(spark, "maintained")
    for stream in _arrivals(spark, sf_dir, f"{target}-log"):
        observed = a.observations_of(stream)
        latest_state.maintain_table(observed, target, f"{target}-progress", compact_after=3).awaitTermination()
    return latest_state.read_files(spark, target, a.library_master(spark, sf_dir))


def _bounded(spark: SparkSession, sf_dir: str) -> str:
    target = scratch_path(spark, "bounded")
    for stream in _arrivals(spark, sf_dir, f"{target}-log"):
        hashes = a.hashes_of(stream)
        first_hash.maintain_bounded(hashes, target, f"{target}-progress", "30 DAYS", compact_after=3).awaitTermination()
    return target


@query
def bounded_first_hash(spark, sf_dir):
    """Earliest hash row of each file and algorithm among those that were not late."""
    return first_hash.read_bounded(spark, _bounded(spark, sf_dir))


@query
def late_hashes(spark, sf_dir):
    """Hash rows that came over 30 days after newer ones, with the step they came in."""
    return first_hash.read_late(spark, _bounded(spark, sf_dir))
