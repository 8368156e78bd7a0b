"""Run named queries on Spark and DuckDB and compare their rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(spark, con, folder: str, name: str, build, sql: str | None) -> str:
    df = build(spark, folder)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows {len(found)} (no SQL)"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} vs {sorted(columns)}"
    if found != expected:
        extra = [r for r in found if r not in set(expected)][:2]
        lost = [r for r in expected if r not in set(found)][:2]
        show = lambda rs: [tuple(str(v)[:80] for v in r) for r in rs]
        return f"FAIL {len(found)} vs {len(expected)} rows; extra {show(extra)} lost {show(lost)}"
    return f"ok {len(found)}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pairloom.session import local_session

    folder = f"/root/testdata/{sys.argv[1]}"
    session, con = local_session(), connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            result = compare(session, con, folder, name, queries[name], oracle.get(name))
        except Exception as error:  # report and go on
            result = f"ERROR {str(error)[:500]}"
        print(f"{name:32s} {time.time() - start:7.2f}s {result}", flush=True)
