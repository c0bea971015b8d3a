"""Compare Spark queries with their DuckDB SQL: ``python -m workload.check DIR [name...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame

from workload.oracle import ORACLES
from workload.queries import QUERIES
from workload.session import local_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _key(value) -> tuple:
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else repr(value))
    if isinstance(value, bool):
        return (1, str(value))
    return (1, repr(float(value)) if isinstance(value, int) else str(value))


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a Spark result and a DuckDB result, if anything."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(names)}"
    if got == want:
        return None
    only_got, only_want = set(got) - set(want), set(want) - set(got)
    sample = f"\n  spark  {sorted(only_got)[:2]}\n  duckdb {sorted(only_want)[:2]}"
    return (
        f"{len(got)} / {len(want)} rows, {len(only_got)} / {len(only_want)} unmatched, "
        f"columns {sorted(names)}{sample}"
    )


def main(sf_dir: str, *names: str) -> int:
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        df = QUERIES[name](spark, sf_dir)
        built = time.time()
        rows = df.count()
        ran = time.time()
        found = difference(df, con, ORACLES[name]())
        bad += found is not None
        print(
            f"{name}: {'ok' if found is None else 'DIFFERS ' + found} "
            f"({rows} rows, build {built - start:.1f}s, run {ran - built:.1f}s)",
            flush=True,
        )
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
