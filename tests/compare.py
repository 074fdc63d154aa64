"""Run queries against their SQL: python tests/compare.py DIR [NAME...]."""

import datetime as dt
import decimal
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(value):
    """One comparable form for values of both engines."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(str, map(plain, value))) + "]"
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(base):
    con = duckdb.connect()
    for p in sorted(Path(base).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def expected(con, sql):
    found = con.execute(sql)
    return canonical([d[0] for d in found.description], found.fetchall())


def main(base, names):
    import __spark_entry__ as entry
    from marlgrid.session import build_session

    spark = build_session("local[8]", **{"spark.driver.memory": "16g", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(base), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            df = queries[name](spark, base)
            got = canonical(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - began
            if name not in sql:
                print(f"{name}: {len(got[1])} rows, {took:.1f} s, no SQL", flush=True)
                continue
            want = expected(con, sql[name])
            if got == want:
                print(f"{name}: same, {len(got[1])} rows, {took:.1f} s", flush=True)
            else:
                bad += 1
                a, b = set(got[1]), set(want[1])
                print(f"{name}: DIFFERS {got[0]} {want[0]} rows {len(got[1])} {len(want[1])}; only ours {sorted(a - b)[:4]}; only SQL {sorted(b - a)[:4]}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {str(e)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
