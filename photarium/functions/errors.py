"""Error codes and the text kept with rows that could not be processed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Machine-readable codes written to quarantine rows.
HASH_UNKNOWN_ALGORITHM = "HASH_UNKNOWN_ALGORITHM"
HASH_DECODE_FAILED = "HASH_DECODE_FAILED"
IO_ERROR = "IO_ERROR"
SET_HASH_FAILED = "DB_SET_HASH_FAILED"
INSERT_METADATA_FAILED = "DB_INSERT_METADATA_FAILED"


class UnknownAlgorithm(ValueError):
    """Raised for a hash name outside the known set."""

    code = HASH_UNKNOWN_ALGORITHM

    def __init__(self, name: str):
        super().__init__(f"{self.code}. algorithm: {name}")
        self.name = name


class NotCatalogued(LookupError):
    """Raised when a hash or tag is given for a file that was never observed."""

    def __init__(self, code: str, file_id: int):
        super().__init__(f"{code}. file_id: {file_id} (never observed)")
        self.code = code
        self.file_id = file_id


def error_text(code: Column, kind: Column, value: Column, detail: Column) -> Column:
    """``CODE. kind: value (detail)``, leaving out parts that are NULL."""
    return F.concat(
        code,
        F.coalesce(F.concat(F.lit(". "), kind, F.lit(": "), value), F.lit("")),
        F.coalesce(F.concat(F.lit(" ("), detail, F.lit(")")), F.lit("")),
    )
