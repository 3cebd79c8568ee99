"""File contents: digests of whole files, decoded pixels, brightness grids."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photarium.functions.errors import HASH_DECODE_FAILED, IO_ERROR, error_text
from photarium.operators import fingerprints
from photarium.operators.numbering import number_rows
from photarium.session import settle

CHUNK_BYTES = 1024 * 1024
LEAF_BYTES = 64 * 1024 ** 2
TASK_BYTES = 8 * 1024 ** 3
TASK_FILES = 100_000
# Bytes of pixels that are worked on together; a larger picture alone.
STACK_BYTES = 8 * 1024 ** 2
# Rec. 709 luma weights for red, green, blue, in ten-thousandths.
LUMA_WEIGHTS = (2126, 7152, 722)


def open_file(path: str):
    """Binary stream of a local path or of a URI that pyarrow has a file system for."""
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_stream(inner)
    return open(path, "rb")


def open_file_at(path: str, place: int):
    """Binary stream of a file from a place in it on."""
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        stream = system.open_input_file(inner)
    else:
        stream = open(path, "rb")
    stream.seek(place)
    return stream


def create_file(path: str):
    """Binary stream to a new local path or URI; folders are made as needed."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(inner.rpartition("/")[0])
        return system.open_output_stream(inner)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, "wb")


def _read_each(use: Callable[[int, Any], str | None], result: str):
    """A function for ``mapInPandas``: opens each file of (id, path), and what ``use`` makes of it or the error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, path in zip(batch["id"], batch["path"]):
                try:
                    with open_file(path) as stream:
                        rows.append((file_id, use(file_id, stream), None, None))
                except OSError as e:
                    message = f"{IO_ERROR}. path: {path} ({e.strerror or e})"
                    rows.append((file_id, None, IO_ERROR, message))
            yield pd.DataFrame(rows, columns=["id", result, "error_code", "error_message"])

    return read


def spread_by_size(work: DataFrame) -> DataFrame:
    """Deal files out in size order, so every task gets a like share of large and small.

    ``work`` has ``id`` and ``size_bytes``. There are at least as many tasks as cores, and
    more where that would give a task too many bytes or files.
    """
    total = work.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files")).first()
    tasks = max(
        work.sparkSession.sparkContext.defaultParallelism,
        -(-total["bytes"] // TASK_BYTES), -(-total["files"] // TASK_FILES),
    )
    dealt = number_rows(work, ["size_bytes", "id"], 0, "_turn")
    return dealt.repartitionById(tasks, (F.col("_turn") % tasks).cast("int")).drop("_turn")


def digest_files(work: DataFrame, hasher: Callable[[], Any] = hashlib.sha256) -> DataFrame:
    """Digest of each file of a work-list (id, path), read in chunks where it lies.

    Only files on the list are opened, and none is held in memory whole. Files that cannot
    be read come back with an error instead of a digest.
    """

    def digest(file_id: int, stream) -> str:
        own = hasher()
        while chunk := stream.read(CHUNK_BYTES):
            own.update(chunk)
        return own.hexdigest()

    return work.select("id", "path").mapInPandas(
        _read_each(digest, "digest"), "id bigint, digest string, error_code string, error_message string"
    )


def leaves(work: DataFrame, size: Column, leaf_bytes: int) -> DataFrame:
    """``work`` with a row for each stretch of ``leaf_bytes`` of its contents: ``leaf`` counts from 0; an empty one has one."""
    last = F.greatest(F.ceil(size / leaf_bytes).cast("bigint") - 1, F.lit(0).cast("bigint"))
    return work.withColumn("leaf", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))


def tree_digest_files(work: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Tree digest of each file of a work-list (id, path, size_bytes), whose stretches are read by different tasks.

    So a file of any size is no long task. A file that cannot be read, or is shorter than listed,
    comes back with an error instead of a digest.
    """
    tasks = work.sparkSession.sparkContext.defaultParallelism

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, path, size, leaf in zip(*(batch[c] for c in ("id", "path", "size_bytes", "leaf"))):
                own, left = hashlib.sha256(), min(leaf_bytes, size - leaf * leaf_bytes)
                try:
                    with open_file_at(path, int(leaf) * leaf_bytes) as stream:
                        while left and (chunk := stream.read(min(CHUNK_BYTES, left))):
                            own.update(chunk)
                            left -= len(chunk)
                    error = "shorter than listed" if left else None
                except OSError as e:
                    error = e.strerror or str(e)
                message = error and f"{IO_ERROR}. path: {path} ({error})"
                rows.append((file_id, size, leaf, None if error else own.hexdigest(), message))
            yield pd.DataFrame(rows, columns=["id", "size_bytes", "leaf", "digest", "error_message"])

    # Even shares of leaves, which are of one size but for the last of each file.
    listed = leaves(work.select("id", "path", "size_bytes"), F.col("size_bytes"), leaf_bytes).repartition(4 * tasks, "id", "leaf")
    read_leaves = settle(
        listed.mapInPandas(read, "id bigint, size_bytes bigint, leaf bigint, digest string, error_message string"), "leaves"
    )
    failed = read_leaves.groupBy("id").agg(F.min("error_message").alias("error_message"))
    digests = fingerprints.combine_leaves(read_leaves, "id", leaf_bytes)
    lost = F.col("error_message").isNotNull()
    return digests.join(failed, "id").select(
        "id", F.when(~lost, F.col("digest")).alias("digest"), F.when(lost, F.lit(IO_ERROR)).alias("error_code"), "error_message"
    )


def stage_images(work: DataFrame, folder: str) -> DataFrame:
    """Copy each file of a work-list (id, path) to ``folder``, under its id; reports errors by id.

    Spark's image source lists folders, and leaves out names such as ``_DSC0001.jpg``. A copy
    is found whatever the file's name, root or time, and nothing else is listed or decoded.
    """

    def copy(file_id: int, stream) -> str:
        name = f"{folder}/{file_id % 1000}/{file_id}"
        with create_file(name) as target:
            while chunk := stream.read(CHUNK_BYTES):
                target.write(chunk)
        return name

    return work.select("id", "path").mapInPandas(
        _read_each(copy, "staged"), "id bigint, staged string, error_code string, error_message string"
    )


def read_staged(spark: SparkSession, folder: str) -> DataFrame:
    """(id, image) of the staged images that Spark can decode."""
    loaded = spark.read.format("image").option("recursiveFileLookup", True).load(folder)
    return loaded.filter(F.col("image.mode") >= 0).select(
        F.regexp_extract("image.origin", "([0-9]+)$", 1).cast("bigint").alias("id"), "image"
    )


def image_hashes(work: DataFrame, folder: str, content: Column, compute: Callable[[Column], Column]) -> DataFrame:
    """(id, hash_value, error_code, error_message) for the images of a work-list (id, path).

    ``content`` is what the hash needs, as a column of ``image``, and ``compute`` the hash of
    it. Both are taken next to the reading of the staged copies in ``folder``, so that only
    hashes are joined, never pixels.
    """
    spark = work.sparkSession
    staged = settle(stage_images(spread_by_size(work), folder), "staged")
    if staged.filter("staged is not null").isEmpty():
        hashed = staged.select("id", F.lit(None).cast("string").alias("hash_value"))
    else:
        contents = read_staged(spark, folder).select("id", content.alias("content"))
        hashed = contents.select("id", compute(F.col("content")).alias("hash_value"))
    paths = staged.select("id", "error_code", "error_message").join(work.select("id", "path"), "id")
    failed = error_text(F.lit(HASH_DECODE_FAILED), F.lit("path"), F.col("path"), F.lit("not a decodable image"))
    lost = F.col("hash_value").isNull() & F.col("error_code").isNull()
    return paths.join(hashed, "id", "left").select(
        "id", "hash_value", F.when(lost, HASH_DECODE_FAILED).otherwise(F.col("error_code")).alias("error_code"),
        F.when(lost, failed).otherwise(F.col("error_message")).alias("error_message"),
    )


def _pixels(data: np.ndarray) -> np.ndarray:
    """RGBA bytes (pictures, height, width, 4) from BGR, BGRA or gray ones."""
    rgba = np.full((*data.shape[:3], 4), 255, dtype=np.uint8)
    if data.shape[3] == 1:
        rgba[..., :3] = data
    else:
        rgba[..., :3] = data[..., 2::-1]
        if data.shape[3] == 4:
            rgba[..., 3] = data[..., 3]
    return rgba


def _stacks(image: pd.DataFrame) -> Iterator[tuple[list[int], np.ndarray]]:
    """Rows of one size and their RGBA pixels, about ``STACK_BYTES`` at a time; rows without pixels are left out."""
    same: dict[tuple[int, int, int], list[int]] = {}
    columns = [image[name].tolist() for name in ("data", "height", "width", "nChannels")]
    for row, (data, *shape) in enumerate(zip(*columns)):
        if data is not None:
            same.setdefault(tuple(map(int, shape)), []).append(row)
    for shape, rows in same.items():
        step = max(1, STACK_BYTES // max(1, 4 * shape[0] * shape[1]))
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            raw = np.frombuffer(b"".join(columns[0][i] for i in part), dtype=np.uint8)
            yield part, _pixels(raw.reshape(len(part), *shape))


def _luma(rgba: np.ndarray) -> np.ndarray:
    """Whole-number brightness of each pixel."""
    red, green, blue = (rgba[..., i].astype(np.int32) * LUMA_WEIGHTS[i] for i in range(3))
    return (red + green + blue) // 10_000


@lru_cache(maxsize=64)
def _shares(cells: int, pixels: int) -> np.ndarray:
    """The share of each pixel of a line in each cell laid over it."""
    edges = np.arange(cells + 1) * (pixels / cells)
    left = np.maximum(edges[:-1, None], np.arange(pixels)[None, :])
    right = np.minimum(edges[1:, None], np.arange(pixels)[None, :] + 1)
    return np.clip(right - left, 0, None) * (cells / pixels)


def area_mean(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean brightness of each cell of a ``height`` x ``width`` grid laid over an image or a stack of images.

    A source pixel that crosses a cell border counts by the share that lies inside.
    """
    return _shares(height, gray.shape[-2]) @ gray @ _shares(width, gray.shape[-1]).T


def pixel_digest(hasher: Callable[[], Any] = hashlib.sha256):
    """Column function: digest of the pixels as RGBA bytes, taken where the pixels are."""

    @F.pandas_udf(T.StringType())
    def digest(image: pd.DataFrame) -> pd.Series:
        out: list[str | None] = [None] * len(image)
        for rows, rgba in _stacks(image):
            for row, pixels in zip(rows, rgba):
                own = hasher()
                own.update(pixels.tobytes())
                out[row] = own.hexdigest()
        return pd.Series(out, dtype=object)

    return digest


@F.pandas_udf(T.BinaryType())
def rgba_bytes(image: pd.DataFrame) -> pd.Series:
    """Pixels as RGBA bytes, whatever the file's own pixel layout and metadata."""
    out: list[bytes | None] = [None] * len(image)
    for rows, rgba in _stacks(image):
        for row, pixels in zip(rows, rgba):
            out[row] = pixels.tobytes()
    return pd.Series(out, dtype=object)


def brightness_grid(width: int, height: int):
    """Column function: decoded image to a row-major grid of mean brightness."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def grid(image: pd.DataFrame) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(image)
        for rows, rgba in _stacks(image):
            grids = area_mean(_luma(rgba), width, height).reshape(len(rows), -1)
            for row, cells in zip(rows, grids):
                out[row] = cells
        return pd.Series(out, dtype=object)

    return grid
