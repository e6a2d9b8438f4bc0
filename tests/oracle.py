"""Run registered queries on Spark and their SQL twins on DuckDB, and compare."""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from queries.registry import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.10g}")
    if isinstance(v, Decimal):
        return float(f"{float(v):.10g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_norm(r[i]) for i in order) for r in data], key=lambda t: [(x is None, str(x)) for x in t])


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = queries()[name](spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = rows(got_cols, got), rows(want_cols, want)
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    types_a = [type(v).__name__ for v in a[0]] if a else []
    types_b = [type(v).__name__ for v in b[0]] if b else []
    return None if types_a == types_b else f"types {types_a} != {types_b}"


if __name__ == "__main__":
    from rowferry.session import session

    spark = session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    wanted = sys.argv[2:] or list(queries())
    con = duck(sf)
    bad = 0
    for n in wanted:
        t0 = time.time()
        try:
            diff = compare(spark, con, n, sf)
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {n} {time.time() - t0:.1f}s {diff or ''}", flush=True)
    print("bad:", bad)
