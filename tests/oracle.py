"""Run queries against their DuckDB SQL on one data folder: python tests/oracle.py FOLDER [NAME...]."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def _norm(v):
    import datetime
    import math

    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(spark, con, sf_dir: str, make, sql: str) -> str:
    """Empty if both give the same rows and columns, else what differs."""
    df = make(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"{len(got)} and {len(want)} rows; {cols}: {odd}"
    return ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    con, bad = duck(sys.argv[1]), 0
    q, o = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or o:
        t = time.time()
        try:
            said = compare(s, con, sys.argv[1], q[n], o[n]) if n in o else f"{q[n](s, sys.argv[1]).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:300]}"
        bad += bool(said)
        if said or time.time() - t > 8:
            print(n, f"{time.time() - t:.1f}s", said, flush=True)
    print(len(sys.argv[2:] or o), "compared,", bad, "differ")
