"""Compare registered queries with their SQL twins: ``python tests/oracle.py <folder> [names]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return repr(0.0 if v == 0 else v)
        return repr(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(con, df, sql):
    """(Spark rows, None) when both agree, else (Spark rows, what differs)."""
    left = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = canonical([d[0] for d in cur.description], cur.fetchall())
    n = len(left[1])
    if left[0] != right[0]:
        return n, f"columns {left[0]} / {right[0]}"
    if n != len(right[1]):
        return n, f"rows {n} / {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            differing = sum(x != z for x, z in zip(left[1], right[1]))
            return n, f"{differing} of {n} rows differ, first {a} / {b}"
    return n, None


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            built = time.time() - start
            if name in oracles:
                n, problem = compare(con, df, oracles[name])
            else:
                n, problem = len(df.collect()), None
            verdict = problem or ("ok" if name in oracles else "ok (rows only)")
        except Exception as err:  # noqa: BLE001
            n, problem, built = -1, repr(err)[:1500], 0
            verdict = problem
        if problem:
            bad.append(name)
        print(f"{name:28s} {n:8d} rows {built:6.2f}s built {time.time() - start:6.2f}s  {verdict}", flush=True)
    print("BAD:", bad)


if __name__ == "__main__":
    main()
