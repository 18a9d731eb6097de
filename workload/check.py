"""Runs registered queries in Spark and their SQL in DuckDB on the same files and compares every row.

``python -m workload.check [sf_dir] [name ...]``"""

import math
import os
import sys
import time
from collections import Counter

import duckdb

from workload import suite

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    res = con.execute(sql)
    return [d[0] for d in res.description], res.fetchall()


def compare(spark, sf_dir: str, name: str) -> dict:
    start = time.time()
    df = suite.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    result = {"name": name, "rows": len(rows), "spark": round(took, 2)}
    if name not in suite.ORACLES:
        return {**result, "ok": None}
    start = time.time()
    columns, expected = oracle(sf_dir, suite.ORACLES[name])
    result["duckdb"] = round(time.time() - start, 2)
    if sorted(columns) != sorted(df.columns):
        return {**result, "ok": False, "why": f"columns {sorted(df.columns)} vs {sorted(columns)}"}
    got, want = _bag(df.columns, rows), _bag(columns, expected)
    extra, missing = got - want, want - got
    result["ok"] = not extra and not missing
    if not result["ok"]:
        result["why"] = f"{sorted(df.columns)} {sum(extra.values())} extra {[*extra][:2]} {sum(missing.values())} missing {[*missing][:2]}"
    return result


def main(argv) -> int:
    from pursuit.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g",
                          spark__ui__enabled="false", spark__checkpoint__dir=os.environ.get("CHECK_STAGING", "/tmp/pursuit-staging"))
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in argv[1:] or suite.QUERIES:
        try:
            result = compare(spark, sf_dir, name)
        except Exception as e:  # report and go on with the other queries
            result = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:700]}"}
        bad += result["ok"] is False
        print(result, flush=True)
    print("failed", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
