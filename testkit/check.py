"""Run queries and their oracle SQL side by side: python -m testkit.check [folder] [name ...]."""

from __future__ import annotations

import decimal
import glob
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark_df, oracle: str, con) -> str:
    mine = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(oracle)
    theirs = rows_of([c[0] for c in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns differ: {mine[0]} / {theirs[0]}"
    if mine[1] == theirs[1]:
        return ""
    a, b = set(mine[1]), set(theirs[1])
    extra, missing = sorted(a - b)[:2], sorted(b - a)[:2]
    return f"rows {len(mine[1])}/{len(theirs[1])}; only here {len(a - b)}: {extra}; only oracle {len(b - a)}: {missing}"


def main() -> int:
    from pagequarry.session import local_session
    from testkit.catalog import ORACLES, QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, failed = local_session(), connect(folder), 0
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                verdict = compare(df, ORACLES[name], con)
            else:
                verdict = "" if df.count() >= 0 else "?"
        except Exception as problem:  # noqa: BLE001
            verdict = f"{type(problem).__name__}: {str(problem)[:700]}"
        failed += bool(verdict)
        print(f"{'ok  ' if not verdict else 'FAIL'} {name} {time.time() - started:.1f}s {verdict}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
