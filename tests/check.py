"""Run registered queries against their SQL statements in DuckDB: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def compare(df, con, sql):
    """None if equal, else a text that says what differs."""
    got = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    types = dict(zip(names, [str(d[1]) for d in result.description]))
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} <> {len(b)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = [f"{c}: {k} <> {types[c]}" for c, k in df.dtypes if kinds.get(k) != types[c]]
    if a != b:
        first = next((x, y) for x, y in zip(a, b) if x != y)
        n = len(set(a) - set(b))
        return f"values differ in {n} of {len(a)} rows, first {str(first)[:600]} types {odd}"
    return f"ok but types {odd}" if odd else None


def main():
    from gradeflow.plans import catalog
    from gradeflow.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    catalog.load_all()
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                 "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    chosen = [n for n in catalog.QUERIES if not names or n in names or any(n.startswith(x[:-1]) for x in names if x.endswith("*"))]
    bad = 0
    for name in chosen:
        began = time.time()
        try:
            df = catalog.QUERIES[name](spark, folder)
            if name in catalog.ORACLE:
                verdict = compare(df, con, catalog.ORACLE[name])
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as e:  # report and go on
            verdict = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        ok = verdict is None or verdict.startswith("rows only")
        bad += not ok
        print(f"{name:28s} {time.time() - began:6.2f}s {verdict or 'ok'}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} fine")


if __name__ == "__main__":
    main()
