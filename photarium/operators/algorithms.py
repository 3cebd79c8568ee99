"""The hash algorithms: names, which files they apply to, how they are computed.

Names are the catalog's labels and say little about the method: ``phash`` is a mean hash
and ``whash`` a double gradient. The two digests are SHA-256; only equality of digests
is ever used, so any collision-free digest gives the same groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column

from photarium.functions.errors import UnknownAlgorithm
from photarium.operators import fingerprints


@dataclass(frozen=True)
class Algorithm:
    """One registered hash.

    ``compute`` turns the input column into a string column: bytes for ``needs='bytes'``,
    RGBA pixel bytes for 'pixels', a brightness grid of ``grid`` cells for 'grid'.
    ``hasher`` makes an object with ``update(bytes)`` and ``hexdigest()`` that gives the same
    value from contents in chunks; files are hashed with it, so 'bytes' and 'pixels' need one.
    """

    name: str
    needs: str
    compute: Callable[[Column], Column]
    file_type: str | None = None
    grid: tuple[int, int] | None = None
    hasher: Callable[[], Any] | None = None
    lists_duplicates: bool = False


ALGORITHMS: dict[str, Algorithm] = {}


def register(entry: Algorithm) -> Algorithm:
    """Add or replace an algorithm; scans and work-lists accept its name from then on."""
    ALGORITHMS[entry.name] = entry
    return entry


def algorithm(name: str) -> Algorithm:
    if name not in ALGORITHMS:
        raise UnknownAlgorithm(name)
    return ALGORITHMS[name]


register(Algorithm("blake3", "bytes", fingerprints.digest, hasher=hashlib.sha256, lists_duplicates=True))
register(Algorithm(
    "content_blake3", "pixels", fingerprints.digest, "image", hasher=hashlib.sha256, lists_duplicates=True))
register(Algorithm(
    "phash", "grid", lambda g: fingerprints.mean_hash(g, 8, 8).cast("string"), "image", (8, 8)))
register(Algorithm(
    "dhash", "grid", lambda g: fingerprints.gradient_hash(g, 9, 8).cast("string"), "image", (9, 8)))
register(Algorithm(
    "whash", "grid", lambda g: fingerprints.double_gradient_hash(g, 5, 5).cast("string"), "image", (5, 5)))
