"""Run queries on Spark and their SQL on DuckDB and compare: check.py [sf] [name ...]."""

from __future__ import annotations

import importlib
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cpus: str = "8") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").appName("plumbline-check")
            .config("spark.sql.shuffle.partitions", os.environ.get("CHECK_PARTITIONS", "8")).config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
            .getOrCreate())


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return repr(v)


#: DuckDB's names of Spark's column types.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
         "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB"}


def other_types(df, description):
    """Columns whose type in Spark and DuckDB differ."""
    want = {d[0]: str(d[1]) for d in description}
    return [f"{c}: {t} / {want[c]}" for c, t in df.dtypes if t in TYPES and TYPES[t] != want[c].replace("TIMESTAMP WITH TIME ZONE", "TIMESTAMP")]


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf):
    t = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return took, len(got), "rows"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return took, len(got), f"COLUMNS {sorted(df.columns)} != {sorted(cols)}"
    if other := other_types(df, res.description):
        return took, len(got), f"TYPES {other}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return took, len(got), "ok"
    left = [x for x in a if x not in set(b)][:3]
    right = [x for x in b if x not in set(a)][:3]
    return took, len(got), f"DIFF spark={len(a)} sql={len(b)}\n    cols {sorted(cols)}\n    spark {left}\n    sql   {right}"


def main() -> int:
    args = sys.argv[1:]
    sf = "/root/testdata/sf" + (args[0] if args else "0.01")
    entry = importlib.import_module("__spark_entry__")
    q, o = entry.queries(), entry.oracle_sql()
    names = args[1:] or list(q)
    names = [n for n in q if any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in names)]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for n in names:
        try:
            took, rows, state = compare(spark, con, q[n], o.get(n), sf)
        except Exception as e:  # report and go on with the next query
            took, rows, state = 0.0, -1, f"ERROR {type(e).__name__}: {str(e)[:700]}"
        if state not in ("ok", "rows") or rows == 0:
            bad += 1
        print(f"{n:28s} {took:6.2f}s {rows:7d} {state}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
