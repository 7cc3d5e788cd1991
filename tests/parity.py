"""Compare registered queries with their DuckDB twins on the driver tables.

Run as a script: ``python tests/parity.py [--sf 0.01] [name ...]``.
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool):
        return value
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return float(f"{float(value):.9g}")
    return value


def shaped(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir: str, run, sql: str) -> str | None:
    """None if equal, else what differs."""
    df = run(spark, sf_dir)
    mine = shaped(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    twin = shaped(names, cursor.fetchall())
    if mine[0] != twin[0]:
        return f"columns {mine[0]} vs {twin[0]}"
    if len(mine[1]) != len(twin[1]):
        return f"rows {len(mine[1])} vs {len(twin[1])}"
    for a, b in zip(mine[1], twin[1]):
        if a != b:
            return f"first difference\n   {str(a)[:600]}\n   {str(b)[:600]}"
    if not mine[1]:
        return "no rows"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--cores", default="8")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from deskloom.session import local_session

    spark = local_session(args.cores)
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, run, oracles[name])
            else:
                rows = run(spark, sf_dir).collect()
                problem = None if rows else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
            cause = getattr(error, "java_exception", None)
            while cause is not None:
                problem += f"\n     caused by {str(cause.toString())[:600]}"
                cause = cause.getCause()
        took = time.time() - start
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {took:6.2f}s {name}", flush=True)
        if problem:
            bad += 1
            print("     " + problem, flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
