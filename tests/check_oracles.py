"""Run queries next to their SQL and report differences: ``python tests/check_oracles.py [sf_dir] [name ..]``."""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import __spark_entry__ as entry  # noqa: E402
from locusframe.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v != v else v for v in r) for r in frame.astype(object).values.tolist()) \
        if len(frame) else []


def compare(spark, con, name, sf_dir):
    """None when rows and columns agree, else a short description."""
    got = entry.queries()[name](spark, sf_dir).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if len(got) else "no rows"
    want = con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = (sorted(map(repr_row, rows.values.tolist())) for rows in (got[sorted(got)].astype(object), want[sorted(want)].astype(object)))
    if a == b:
        return None
    off = [(x, y) for x, y in zip(a, b) if x != y]
    return f"rows {len(a)} / {len(b)}, {len(off)} differ, first {off[:1]}"


def repr_row(row):
    return tuple("null" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
                 for v in row)


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            result = f"{type(e).__name__}: {str(e)[:600]}"
        bad += result is not None
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{name:34s} {kind:5s} {time.time() - start:6.1f}s {'ok' if result is None else result}", flush=True)
    print("failed:", bad)
