"""Runs registered queries beside their SQL in DuckDB and compares the rows.

Usage: python tests/oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ", timespec="microseconds")
    return v if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark_df, con, sql):
    got_cols = spark_df.columns
    got = rows_of(got_cols, spark_df.collect())
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} against {sorted(want_cols)}", len(got), types
    if got != want:
        a, b = set(got), set(want)
        return (
            f"{len(got)} rows against {len(want)}; only Spark: {sorted(a - b, key=repr)[:3]}; only SQL: {sorted(b - a, key=repr)[:3]}",
            len(got),
            types,
        )
    return None, len(got), types


_SAME = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "string": {"VARCHAR", "JSON"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN", "bool"},
    "timestamp_ntz": {"TIMESTAMP"},
}


def main():
    import __spark_entry__ as entry
    from muster.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        for full in [q for q in queries if q.startswith(name)]:
            t = time.time()
            try:
                df = queries[full](spark, sf_dir)
                if full in sqls:
                    problem, n, types = compare(df, con, sqls[full])
                    odd = [f"{f.name}:{f.dataType.simpleString()}/{types.get(f.name)}" for f in df.schema if types.get(f.name) not in _SAME.get(f.dataType.simpleString(), set())]
                    note = f" TYPES {odd}" if odd and not problem else ""
                else:
                    problem, n, note = None, df.count(), " (rows only)"
            except Exception as e:
                problem, n, note = f"{type(e).__name__}: {str(e)[:1500]}", 0, ""
            bad += problem is not None
            print(f"{'FAIL' if problem else 'ok  '} {full} {n} rows {time.time() - t:.1f}s{note} {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
