"""Run registered queries next to their DuckDB check: ``python -m tests.oracle [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in records), key=repr)


def difference(spark_df, relation) -> str | None:
    """None when both hold the same rows; otherwise a short account of the difference."""
    got_cols, want_cols = spark_df.columns, relation.columns
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    got = rows_of(got_cols, [tuple(r) for r in spark_df.collect()])
    want = rows_of(want_cols, relation.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}: {got[:2]} vs {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {g} != {w}"
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            if a is not None and type(a) is not type(b):
                return f"type {type(a)} != {type(b)} for {a!r}"
    return None


def main(argv: list[str]) -> int:
    from grainfold.plans import ORACLES, QUERIES
    from grainfold.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(**{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), []
    names = [n for n in QUERIES if not argv or any(n.startswith(a) for a in argv)]
    for n in names:
        start = time.time()
        try:
            df = QUERIES[n](spark, folder)
            if n in ORACLES:
                note = difference(df, con.sql(ORACLES[n]))
            else:
                note = None if df.count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
        took = time.time() - start
        print(f"{'ok  ' if note is None else 'BAD '} {n} {took:.1f}s {note or ''}", flush=True)
        if note:
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} good; bad: {bad}")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
