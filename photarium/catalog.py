"""The catalog on storage: its tables, and the calls a library user makes.

Tables are parquet folders below one path. Every write appends; the views are the
operators of ``operators.latest`` over the logs. Calls that take one file are one-row
cases of the set-wise operators; use the set-wise calls for more than a few files.

One writer at a time: ids continue from the largest one present, so two scans must not
run side by side on one catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photarium import schemas
from photarium.functions import errors
from photarium.operators import hashing, latest, metadata, observe, reports, worklist
from photarium.operators.algorithms import algorithm
from photarium.operators.numbering import largest
from photarium.plans import runs, scans
from photarium.session import configure, releasing, scratch_path, settle
from photarium.settings import ScanSettings
from photarium.sources import inventory, media
from photarium.sources.tables import append_table, read_table

RESULTS = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("hash_name", T.StringType()),
    T.StructField("hash_value", T.StringType()),
])
ENTRIES = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("namespace", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("value", T.StringType()),
])


class Catalog:
    """Tables of one media library."""

    def __init__(self, spark: SparkSession, path: str, settings: ScanSettings = ScanSettings()):
        self.spark = configure(spark)
        self.path = path.rstrip("/")
        self.settings = settings
        self._create_tables()

    # --- tables ------------------------------------------------------------------------

    def _create_tables(self) -> None:
        """Create the tables that do not exist yet; existing ones are left alone."""
        present = inventory.reachable_roots(self.spark, [self._table_path(n) for n in schemas.TABLES])
        for name, schema in schemas.TABLES.items():
            if self._table_path(name) not in present:
                self._append(self.spark.createDataFrame([], schema), name)

    def _table_path(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _append(self, rows: DataFrame, name: str) -> None:
        append_table(
            schemas.conform(rows, schemas.TABLES[name]), self._table_path(name), schemas.PARTITION_COLUMNS.get(name)
        )

    def table(self, name: str) -> DataFrame:
        """One of ``schemas.TABLES``, as of now."""
        return schemas.conform(
            read_table(self.spark, self._table_path(name), schemas.TABLES[name]), schemas.TABLES[name]
        )

    @property
    def master(self) -> DataFrame:
        return self.table("file_master")

    @property
    def stats(self) -> DataFrame:
        return self.table("file_stats")

    @property
    def hashes(self) -> DataFrame:
        return self.table("file_hashes")

    @property
    def metadata(self) -> DataFrame:
        return self.table("file_metadata")

    # --- views -------------------------------------------------------------------------

    def files(self) -> DataFrame:
        """Every file with its latest observation."""
        return latest.files_view(self.master, self.stats)

    def latest_metadata(self) -> DataFrame:
        return latest.latest_metadata(self.metadata)

    def latest_hashes(self, hash_name: str | None = None) -> DataFrame:
        return latest.latest_hashes(self.hashes, hash_name)

    def active_files(self, root_dir: str) -> DataFrame:
        """Present files of a root: id, path, size and mtime."""
        return latest.active_in_root(self.files(), root_dir)

    def known_paths(self, root_dir: str) -> DataFrame:
        """Paths of a root's present files."""
        return latest.known_paths(self.files(), root_dir).select("path")

    def file_exists(self, path: str) -> bool:
        """Was this path ever catalogued?"""
        return not self.master.filter(F.col("path") == path).isEmpty()

    def history(self, file_id: int) -> DataFrame:
        return latest.file_history(self.stats, file_id)

    # --- observations ------------------------------------------------------------------

    def record_listing(self, listing: DataFrame) -> None:
        """Add identities for new paths and one observation per listed file."""
        described = observe.describe(listing, self.settings)
        self._append(observe.new_files(described, self.master), "file_master")
        self._append(
            observe.observations(described, self.master, self.stats, F.current_timestamp()), "file_stats"
        )

    def upsert_file(
        self, path: str, root_dir: str, size_bytes: int, mtime_secs: int = 0, mtime_nanos: int = 0
    ) -> int:
        """Record one observation of one file; returns its id."""
        row = [(root_dir, 0, path, size_bytes, mtime_secs, mtime_nanos)]
        self.record_listing(self.spark.createDataFrame(row, schemas.LISTING))
        return self.master.filter(F.col("path") == path).first()["id"]

    def mark_missing(self, *gone: str) -> None:
        """Flag files as missing; paths never catalogued are ignored."""
        self.mark_missing_paths(self.spark.createDataFrame([(p,) for p in gone], "path string"))

    def mark_missing_paths(self, gone: DataFrame) -> None:
        rows = observe.mark_missing(gone, self.master, self.stats, F.current_timestamp())
        self._append(rows, "file_stats")

    def _require_observed(self, file_id: int, code: str) -> None:
        if self.stats.filter(F.col("file_id") == file_id).isEmpty():
            raise errors.NotCatalogued(code, file_id)

    # --- hashes ------------------------------------------------------------------------

    def set_hash(self, file_id: int, hash_name: str, value: str) -> None:
        """Store one hash; an unknown name or a file never observed is an error."""
        algorithm(hash_name)
        self._require_observed(file_id, errors.SET_HASH_FAILED)
        self.record_hashes(self.spark.createDataFrame([(file_id, hash_name, value)], RESULTS))

    def set_perceptual_hash(self, file_id: int, hash_name: str, value: int) -> None:
        """Store one 64-bit fingerprint as decimal text."""
        self.set_hash(file_id, hash_name, str(value))

    def record_hashes(self, results: DataFrame) -> DataFrame:
        """Append good results (file_id, hash_name, hash_value, errors); returns the failures."""
        output = scans.hash_scan(results, self.stats, F.current_timestamp())
        self._append(output.new_hashes, "file_hashes")
        return output.failures

    def files_needing_hash(
        self, hash_name: str, file_type: str | None = None, refresh_stale: bool = False
    ) -> DataFrame:
        """Present files without this hash, smallest first."""
        if refresh_stale:
            work = worklist.needing_hash_or_stale(self.files(), self.stats, self.hashes, hash_name, file_type)
        else:
            work = worklist.needing_hash(self.files(), self.hashes, hash_name, file_type)
        return worklist.smallest_first(work)

    def hash_coverage(self) -> DataFrame:
        return worklist.hash_coverage(self.files(), self.hashes)

    # --- metadata ----------------------------------------------------------------------

    def record_metadata(self, entries: DataFrame) -> None:
        """Append tags (file_id, namespace, tag, value), stamped with the latest observation."""
        stamped = metadata.stamp(entries, self.stats, row_per_file=False)
        self._append(metadata.log_rows(stamped, F.current_timestamp()), "file_metadata")

    def insert_metadata(self, file_id: int, entries: list[tuple[str, str, str | None]]) -> None:
        """Append tags of one file; a file never observed is an error."""
        if entries:
            self._require_observed(file_id, errors.INSERT_METADATA_FAILED)
            rows = [(file_id, *entry) for entry in entries]
            self.record_metadata(self.spark.createDataFrame(rows, ENTRIES))

    def files_needing_metadata(self) -> DataFrame:
        """Present images and videos without tags."""
        return worklist.needing_metadata(self.files(), self.metadata).select("id", "path", "file_type")

    # --- scans -------------------------------------------------------------------------

    def scan(self, list_files=inventory.walk) -> DataFrame:
        """List the settings' roots and record what is there and what is gone; returns totals.

        Roots that do not exist are skipped, and their files stay as they were. All steps
        read one stored listing, so files that change meanwhile cannot disagree.
        """
        roots = inventory.reachable_roots(self.spark, inventory.expand_roots(self.settings.roots))
        with releasing(self.spark):
            listing = settle(list_files(self.spark, roots), "listing")
            output = scans.library_scan(listing, roots, self.master, self.stats, F.current_timestamp(), self.settings)
            self._append(output.new_master, "file_master")
            self._append(output.new_stats, "file_stats")
            totals = output.totals.collect()  # one row
        return self.spark.createDataFrame(totals, output.totals.schema)

    def changes(self, list_files=inventory.walk) -> DataFrame:
        """State of every path now against the latest observations, without recording it."""
        roots = inventory.reachable_roots(self.spark, inventory.expand_roots(self.settings.roots))
        return observe.changes(list_files(self.spark, roots), self.files())

    def scan_metadata(self, tags: DataFrame, probes: DataFrame) -> None:
        """Append tags for files without any, from typed tags and probe documents by path.

        ``tags`` is (path, tags), ``probes`` is (path, probe_json), one row per file.
        """
        rows = scans.metadata_scan(
            self.master, self.stats, self.metadata, tags, probes, F.current_timestamp(), key="path"
        )
        self._append(rows, "file_metadata")

    def scan_hashes(self, hash_name: str, refresh_stale: bool = False, retry: bool = False) -> DataFrame:
        """Compute one hash for the files due for it; returns the failures.

        Files that could not be decoded are left out until they change, or with ``retry``.
        Results are stored before they are appended, so looking at the failures hashes
        nothing again.
        """
        target = scratch_path(self.spark, "hashed")
        with releasing(self.spark):
            due = scans.hash_work(self.master, self.stats, self.hashes, hash_name, refresh_stale)
            if not retry:
                due = worklist.without_failures(due, self.table("hash_failures"), hash_name)
            work = settle(due, "hash-work")
            results = settle(self._compute(work, hash_name), "hashed", target)
            undecodable = results.filter(F.col("error_code") == errors.HASH_DECODE_FAILED).select(
                F.col("file_id").alias("id"), "hash_name"
            )
            self._append(undecodable.join(work, "id").select(
                F.col("id").alias("file_id"), "hash_name", "size_bytes", "mtime_secs", F.current_timestamp().alias("failed_at")
            ), "hash_failures")
        return self.record_hashes(results)

    def _compute(self, work: DataFrame, hash_name: str) -> DataFrame:
        method = algorithm(hash_name)
        if method.needs != "grid" and method.hasher is None:
            raise ValueError(f"{hash_name} has no hasher for contents of files")
        if method.needs == "bytes":
            found = media.digest_files(media.spread_by_size(work), method.hasher).withColumnRenamed("digest", "hash_value")
        else:
            if method.needs == "pixels":
                content, compute = media.pixel_digest(method.hasher)("image"), lambda digest: digest
            else:
                content, compute = media.brightness_grid(*method.grid)("image"), method.compute
            found = media.image_hashes(work, scratch_path(self.spark, "images"), content, compute)
        return found.select(
            F.col("id").alias("file_id"), F.lit(hash_name).alias("hash_name"), "hash_value", "error_code", "error_message"
        )

    # --- reports -----------------------------------------------------------------------

    def library_stats(self) -> DataFrame:
        return reports.library_stats(latest.latest_stats(self.stats))

    def duplicates(self, hash_name: str) -> DataFrame:
        """The 50 groups of identical files that take the most space."""
        return reports.duplicates_report(self.hashes, self.stats, hash_name)

    # --- runs --------------------------------------------------------------------------

    def create_run(self, scan_level: int, hash_type: str | None = None, root_dir: str | None = None) -> int:
        run_id = largest(self.table("run_events"), "run_id") + 1
        self._run_event(run_id, runs.STARTED, scan_level=scan_level, hash_type=hash_type, root_dir=root_dir)
        return run_id

    def update_run(self, run_id: int, files_processed: int, files_total: int | None = None) -> None:
        self._run_event(run_id, runs.PROGRESS, files_processed=files_processed, files_total=files_total)

    def complete_run(self, run_id: int, status: str, error_message: str | None = None) -> None:
        self._run_event(run_id, runs.COMPLETED, status=status, error_message=error_message)

    def _run_event(self, run_id: int, event: str, **values) -> None:
        self._append(runs.run_event(self.spark, run_id, event, **values), "run_events")

    def runs(self) -> DataFrame:
        return runs.run_status(self.table("run_events"))

    def run_progress(self) -> DataFrame:
        return runs.progress_snapshots(self.table("run_events"))
