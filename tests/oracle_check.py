"""Run every registered analytic in Spark and its DuckDB SQL on the same tables and
compare row count, column names and values (order-insensitive, doubles bit for bit).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

VIEWS = ("region nation customer supplier part orders lineitem events documents embeddings "
         "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in VIEWS:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else v  # bit for bit
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, sf_dir: str, names=None) -> dict[str, dict]:
    import __spark_entry__ as E
    from pitchframe.plans.catalog import ANALYTICS

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in (names or [q for q in qs if q in ANALYTICS]):
        t = time.time()
        rec = {}
        try:
            s = qs[name](spark, sf_dir).toPandas()
            rec["spark_s"] = round(time.time() - t, 2)
            o = con.execute(sqls[name]).fetchdf()
            rec["rows"] = (len(s), len(o))
            rec["cols_match"] = sorted(s.columns) == sorted(o.columns)
            rec["values_match"] = rec["cols_match"] and canon(s) == canon(o)
            if not rec["cols_match"]:
                rec["cols"] = (sorted(s.columns), sorted(o.columns))
        except Exception as e:  # report and continue
            rec["error"] = f"{type(e).__name__}: {str(e)[:300]}"
        out[name] = rec
    return out


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, names)
    bad = 0
    for k, v in res.items():
        ok = v.get("values_match") and v["rows"][0] == v["rows"][1]
        bad += not ok
        print(("OK  " if ok else "BAD ") + k, v)
    print(f"{len(res) - bad}/{len(res)} match")
