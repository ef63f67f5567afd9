"""Run registered queries next to their reference SQL and compare the rows.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clipsight.plans.registry import TABLES  # noqa: E402


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool):
        return int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows vs {len(right[1])}"
    different = [(a, b) for a, b in zip(left[1], right[1]) if repr(a) != repr(b)]
    if different:
        return f"{len(different)} of {len(left[1])} rows differ, first: {str(different[0])[:1200]}"
    return None if left[1] else "no rows"


def main() -> None:
    import __spark_entry__ as registry
    from clipsight.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = database(folder), registry.oracle_sql()
    for name, run in registry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = compare(run(spark, folder), con, oracle[name])
            else:
                problem = f"rows only: {run(spark, folder).count()}"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{name:24s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
