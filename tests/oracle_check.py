"""Run the named queries on Spark and their SQL on DuckDB and compare every value.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


KINDS = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and a SQL result; empty when equal."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    kinds = {d[0]: str(d[1]) for d in expected.description}
    want = rows_of(names, expected.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} / {kinds[name]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} / {len(want)}")
    different = [(g, w) for g, w in zip(got, want) if g != w]
    if different:
        problems.append(f"{len(different)} rows differ, first {different[0]}")
    return problems


def main() -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                problems = compare(df, con, sqls[name])
                state = "ok" if not problems else "DIFFERENT " + "; ".join(problems)[:1500]
            else:
                state = f"rows only: {df.count()}"
        except Exception as error:
            state = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        bad += state.startswith(("DIFF", "FAIL"))
        print(f"{name:28s} {time.time() - start:6.2f}s {state}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
