"""Run named queries in Spark and their oracles in DuckDB and compare.

Usage: ``python -m ratelens.plans.verify [sf_dir] [name ...]``

Comparison: same column names (sorted), same row count, and the same
multiset of rows after normalising values (floats to 10 significant
digits, -0.0 to 0.0, NaN to None). With RATELENS_STRICT=1 floats must be
bit-identical.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from ..sources.tables import BASE_TABLES, table_path


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == 0:
            return 0.0
        if os.environ.get("RATELENS_STRICT"):  # exact binary value
            return v
        return float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols: list[str], records) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           for x in r))


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_types = dict(sdf.dtypes)
    s_rows = [tuple(r) for r in sdf.collect()]
    # as a view first: a statement that only runs on its own is no usable oracle
    con.execute(f'CREATE OR REPLACE TEMP VIEW "oracle_{name}" AS {sql}')
    rel = con.sql(f'SELECT * FROM "oracle_{name}"')
    d_cols = rel.columns
    d_types = dict(zip(d_cols, [str(t) for t in rel.types]))
    d_rows = rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ, e.g. {diffs}"
    types = {c: (s_types[c], d_types[c]) for c in s_cols}
    return True, f"{len(s_rows)} rows; types {types}"


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from ..plans.catalog import QUERIES
    from ..plans.oracles import oracle_sql
    from ..session import get_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(oracle_sql())
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck_connect(sf_dir)
    sql = oracle_sql()
    bad = 0
    for name in names:
        t = time.time()
        try:
            ok, msg = compare(spark, con, name, QUERIES[name], sql[name], sf_dir)
        except Exception as e:  # report and continue
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {name} ({time.time() - t:.1f}s) {msg if not ok else msg[:160]}",
              flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
