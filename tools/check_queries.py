"""Run registered queries against DuckDB on the same files and report differences.

Usage: python tools/check_queries.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from plumbline.plans import load  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    bad = 0
    for name, q in load().items():
        if a.names and not any(name.startswith(n) for n in a.names):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, a.sf)
            got = [tuple(r) for r in df.collect()]
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
            if not str(e):
                traceback.print_exc()
            continue
        took = time.time() - t0
        if not q.sql:
            print(f"rows {name} {len(got)} rows, {took:.1f}s", flush=True)
            continue
        try:
            rel = con.execute(q.sql)
            names, types = [d[0] for d in rel.description], [str(d[1]) for d in rel.description]
            want = rel.fetchall()
        except Exception as e:
            bad += 1
            print(f"FAIL {name} (SQL): {str(e)[:800]}", flush=True)
            continue
        kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        odd = [f"{n}: {mine.get(n)} / {t}" for n, t in zip(names, types) if kinds.get(mine.get(n), t) != t]
        if sorted(names) != sorted(df.columns):
            bad += 1
            print(f"DIFF {name}: columns {sorted(df.columns)} / {sorted(names)}", flush=True)
            continue
        x, y = rows_of(df.columns, got), rows_of(names, want)
        if x != y:
            bad += 1
            only_x = [r for r in x if r not in set(y)][:2] if len(x) < 50000 else []
            only_y = [r for r in y if r not in set(x)][:2] if len(y) < 50000 else []
            print(f"DIFF {name}: {len(x)} / {len(y)} rows\n  spark {str(only_x)[:700]}\n  sql   {str(only_y)[:700]}", flush=True)
        elif odd:
            bad += 1
            print(f"TYPE {name}: {odd}", flush=True)
        else:
            print(f"ok   {name} {len(got)} rows, {took:.1f}s", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
