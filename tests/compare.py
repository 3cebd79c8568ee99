"""Run registered queries against their SQL and compare the rows.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(type_name: str) -> str:
    """Common name of a Spark or DuckDB column type."""
    names = {
        "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean",
        "TIMESTAMP": "timestamp", "timestamp_ntz": "timestamp",
    }
    return names.get(type_name, type_name)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and a statement's result, row order aside."""
    result = con.execute(sql)
    expected_kinds = {c[0]: kind(str(c[1])) for c in result.description}
    kinds = {name: kind(t) for name, t in df.dtypes}
    if kinds != expected_kinds:
        return [f"schema: {kinds} expected {expected_kinds}"]
    names = sorted(kinds)
    positions = [[c[0] for c in result.description].index(n) for n in names]
    expected = Counter(tuple(row[i] for i in positions) for row in result.fetchall())
    found = Counter(tuple(row) for row in df.select(*names).collect())
    if found == expected:
        return []
    extra, lacking = found - expected, expected - found
    return [
        f"rows: {sum(found.values())} expected {sum(expected.values())}", f"columns: {names}",
        f"extra: {list(extra)[:3]}", f"lacking: {list(lacking)[:3]}",
    ]


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").appName("compare").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name, fn in queries().items():
        if name not in oracle_sql() or len(argv) > 1 and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            problems = differences(df, con, oracle_sql()[name])
            rows = df.count() if not problems else -1
        except Exception as e:  # noqa: BLE001
            problems, rows = [f"{type(e).__name__}: {str(e)[:1500]}"], -1
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:28s} rows={rows} {time.time() - start:.1f}s", flush=True)
        for p in problems:
            print("     ", p[:1500], flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
