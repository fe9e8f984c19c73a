"""Run registered queries and compare them with their SQL checks in DuckDB.

usage: python tools/check.py SF_DIR [query ...]
"""

from __future__ import annotations

import datetime as dt
import glob
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cinderlog import plans  # noqa: E402
from cinderlog.session import build_session  # noqa: E402


def local_session(cores: int = 8):
    return build_session(
        "check", f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        out.append(tuple(repr(r[i]) for i in order))
    return sorted(out)


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, float]:
    began = time.time()
    df = plans.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - began
    sql = plans.oracles().get(name)
    if sql is None:
        return f"rows-only {len(got)}", took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"FAIL columns {sorted(df.columns)} != {sorted(names)}", took
    a, b = normal(got, df.columns), normal(want, names)
    if a == b:
        return f"ok {len(a)} rows", took
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return f"FAIL {len(a)} vs {len(b)} rows\n   spark {str(only_a)[:1500]}\n   sql   {str(only_b)[:1500]}", took


def main():
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(plans.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            result, took = compare(spark, con, name, sf_dir)
        except Exception:
            result, took = "FAIL " + traceback.format_exc()[-1800:], 0.0
        bad += result.startswith("FAIL")
        print(f"{name:28s} {took:6.2f}s {result}", flush=True)
    print(f"{len(names)} queries, {bad} failed")
    spark.stop()


if __name__ == "__main__":
    main()
