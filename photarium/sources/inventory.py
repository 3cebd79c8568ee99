"""File listings of directory roots.

Two readers with one output shape (``schemas.LISTING``):

* ``walk`` lists mounted file systems through a Python data source with a partition per group of
  folders. It sees hidden files and keeps nanosecond mtimes.
* ``list_objects`` uses Spark's own file index and reads any storage Spark can. It skips
  names that start with ``.`` or ``_`` and keeps milliseconds.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructField, StructType

from photarium.functions import paths
from photarium.schemas import LISTING, conform

# Paths travel as the bytes the file system holds; they need not be valid UTF-8.
_BATCH = 10_000
# Folders opened to plan a listing, and files of one folder that a task takes.
PLANNED_FOLDERS = 20_000
SHARE_FILES = 50_000


def expand_roots(roots: Sequence[str], home: str | None = None) -> list[str]:
    """Roots with a leading ``~`` replaced by the home folder."""
    base = home or os.path.expanduser("~")
    return [base if r == "~" else os.path.join(base, r[2:]) if r.startswith("~/") else r for r in roots]


def reachable_roots(spark: SparkSession, roots: Sequence[str]) -> list[str]:
    """The roots that exist, in order. An absent root is skipped, not treated as empty."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def exists(root: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(root)
        return path.getFileSystem(conf).exists(path)

    return [r for r in roots if exists(r)]


@dataclass
class Share(InputPartition):
    """What one task lists: folders with all below them (``whole``) or without, and single files.

    Of a folder with very many entries each of ``parts`` tasks takes the names whose hash is ``part``.
    """

    root_dir: str
    root_order: int
    folders: list[bytes]
    whole: bool = True
    part: int = 0
    parts: int = 1
    files: list[bytes] = field(default_factory=list)


def _entries(folder: bytes) -> Iterator[tuple[bool, bytes]]:
    """(is a folder, path) of a folder's sub-folders and files; links are neither, an unreadable folder has none."""
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                is_folder = entry.is_dir(follow_symlinks=False)
                if is_folder or entry.is_file(follow_symlinks=False):
                    yield is_folder, entry.path
    except OSError:
        pass


class InventoryReader(DataSourceReader):
    """Plans shares folder by folder until there are enough, and lists them in tasks.

    Planning opens at most ``PLANNED_FOLDERS`` folders, level by level; what lies below the last
    level is listed by tasks, a share of those folders each. It reads names only, no sizes or times.
    """

    def __init__(self, roots: Sequence[str], shares: int):
        self.roots, self.shares = roots, shares

    def partitions(self) -> list[InputPartition]:
        planned: list[InputPartition] = []
        level: list[tuple[str, int, bytes]] = []
        for order, root in enumerate(self.roots):
            raw = os.fsencode(root)
            if os.path.isdir(raw):
                level.append((root, order, raw))
            else:
                planned.append(Share(root, order, [], files=[raw]))
        opened = 0
        while level and len(level) < self.shares and opened < PLANNED_FOLDERS:
            following = []
            for root, order, folder in level:
                files = 0
                for is_folder, raw in _entries(folder):
                    files += not is_folder
                    if is_folder:
                        following.append((root, order, raw))
                opened += 1
                parts = -(-files // SHARE_FILES)
                planned += [Share(root, order, [folder], False, part, parts) for part in range(parts)]
            level = following
        by_root: dict[tuple[str, int], list[bytes]] = {}
        for root, order, folder in level:
            by_root.setdefault((root, order), []).append(folder)
        for (root, order), folders in by_root.items():
            step = max(1, len(level) // self.shares)
            planned += [Share(root, order, folders[at:at + step]) for at in range(0, len(folders), step)]
        return planned or [Share("", 0, [])]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for raw in self._files(share):
            try:
                info = os.stat(raw, follow_symlinks=False)
            except OSError:
                continue
            if stat.S_ISREG(info.st_mode):
                since_epoch = max(info.st_mtime_ns, 0)
                rows.append((
                    share.root_dir, share.root_order, raw.decode("utf-8", "replace"), info.st_size,
                    since_epoch // 10**9, since_epoch % 10**9,
                ))
            if len(rows) >= _BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    @staticmethod
    def _files(share: Share) -> Iterator[bytes]:
        yield from share.files
        waiting = list(share.folders)
        while waiting:
            for is_folder, raw in _entries(waiting.pop()):
                if is_folder:
                    if share.whole:
                        waiting.append(raw)
                elif share.parts == 1 or crc32(raw) % share.parts == share.part:
                    yield raw


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=LISTING.fieldNames())


class InventorySource(DataSource):
    """Spark data source ``inventory``: options ``roots``, a JSON list of mounted paths, and ``shares``."""

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> StructType:
        return StructType([StructField(f.name, f.dataType) for f in LISTING.fields])

    def reader(self, schema: StructType) -> InventoryReader:
        return InventoryReader(json.loads(self.options["roots"]), int(self.options["shares"]))


def walk(spark: SparkSession, roots: Sequence[str], shares: int | None = None) -> DataFrame:
    """Every regular file below the given existing roots, hidden ones included, in one job.

    Folders are dealt out over about ``shares`` tasks (by default four per core) and each lists and
    stats its own; a folder of very many files is shared by several, so neither a wide nor a flat tree is
    one long task. Folders that cannot be read and links are left out.
    """
    spark.dataSource.register(InventorySource)
    wanted = shares or 4 * spark.sparkContext.defaultParallelism
    listing = spark.read.format("inventory").option("roots", json.dumps(list(roots))).option("shares", wanted).load()
    return conform(listing, LISTING)


def list_objects(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Every visible file below the given existing roots, through Spark's file index."""
    parts = []
    for i, root in enumerate(roots):
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select("path", "length", "modificationTime")
        )
        parts.append(files.select(
            F.lit(root).alias("root_dir"),
            F.lit(i).alias("root_order"),
            F.regexp_replace("path", "^file:/+", "/").alias("path"),
            F.col("length").alias("size_bytes"),
            paths.mtime_seconds(F.col("modificationTime")).alias("mtime_secs"),
            paths.mtime_nanos(F.col("modificationTime")).alias("mtime_nanos"),
        ))
    if not parts:
        return spark.createDataFrame([], LISTING)
    listing = parts[0]
    for part in parts[1:]:
        listing = listing.unionByName(part)
    return conform(listing, LISTING)
