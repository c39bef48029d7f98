"""Compare registered Spark queries with their DuckDB oracle SQL.

Mirrors the driver's check: row count, column names (sorted) and an
order-insensitive comparison of the values.  Usable from pytest and as a
script: ``python tests/oracle_compare.py [sf_dir] [key ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(float(v)))
    if isinstance(v, decimal.Decimal):
        return (1, str(v.normalize()) if v == v.to_integral() else str(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return (1, v.isoformat())
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, int):
        return (1, str(v))
    return (1, str(v))


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return False, f"row count differs: spark={len(s_rows)} duck={len(d_rows)}"
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_order = [d_cols.index(s_cols[i]) for i in order]
    a = sorted(tuple(_norm(r[i]) for i in order) for r in s_rows)
    b = sorted(tuple(_norm(r[i]) for i in d_order) for r in d_rows)
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ, e.g. {diffs}"
    return True, f"{len(s_rows)} rows"


def main(argv):
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    from acvlens.plans.oracle import ORACLE_SQL
    from acvlens.plans.registry import QUERIES
    from acvlens.session import get_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = argv[2:]
    spark = get_session("local[8]")
    con = duck_connection(sf_dir)
    bad = 0
    for k, q in QUERIES.items():
        if only and k not in only:
            continue
        sql = ORACLE_SQL.get(k)
        if sql is None:
            print(f"{k:34s} NO-ORACLE")
            continue
        try:
            ok, msg = compare(q(spark, sf_dir), con, sql)
        except Exception as e:  # report and continue
            ok, msg = False, f"{type(e).__name__}: {str(e)[:300]}"
        bad += not ok
        print(f"{k:34s} {'OK ' if ok else 'BAD'} {msg}")
    print(f"{bad} mismatches")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
