"""Spark-vs-DuckDB comparison of the registered queries.

Usable from pytest (``tests/test_contract.py``) and standalone:
``python tests/contract_check.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canon(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(float(v)))
    if isinstance(v, bool):
        return (2, str(int(v)))
    if isinstance(v, int):
        return (1, repr(float(v))) if abs(v) < 2**53 else (1, str(v))
    if hasattr(v, "item"):
        return _canon(v.item())
    return (3, str(v))


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_canon(r[i]) for i in order) for r in records)


def compare(spark, con, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    s_cols = list(sdf.columns)
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
        return problems, len(s_rows), len(d_rows)
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems, len(s_rows), len(d_rows)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from lifetrail import get_session
    import __spark_entry__ as e
    spark = get_session(cores=4)
    con = duck(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name in (names or sorted(qs)):
        if name not in sqls:
            try:
                print(f"{name:34s} rows-only  {qs[name](spark, sf_dir).count()} rows")
            except Exception as ex:  # noqa: BLE001
                bad += 1
                print(f"{name:34s} BAD ERROR {type(ex).__name__}: {str(ex)[:300]}")
            continue
        try:
            problems, ns, nd = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as ex:  # noqa: BLE001
            problems, ns, nd = [f"ERROR {type(ex).__name__}: {str(ex)[:300]}"], -1, -1
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{name:34s} {status} spark={ns} duck={nd} {'; '.join(problems)}")
    print(f"{bad} mismatching of {len(names or qs)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
