"""Runs registered queries against their SQL in DuckDB. ``python tests/oracle.py [sf] [name-prefix ...]``"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(canonical(r[i]) for i in order) for r in rows], key=repr)


def check(spark, con, name, sf_dir):
    """None when equal, else a short account of the difference."""
    from panelcast.queries import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return None if got else "no rows"
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "both empty"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return None
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, columns {sorted(columns)}, first: {bad[0]}"


def main():
    from panelcast.queries import ORACLES, QUERIES
    from panelcast.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = check(spark, con, name, sf_dir)
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'ok  ' if problem is None else 'BAD '} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
        bad += problem is not None
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
