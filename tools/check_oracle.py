"""Run registered queries on Spark and their SQL on DuckDB, compare rows exactly.

usage: python tools/check_oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventide.plans import catalog  # noqa: E402
from eventide.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> list[str]:
    spark_rows = df.collect()
    rel = con.sql(sql)
    duck_rows = rel.fetchall()
    problems = []
    ours = dict(df.dtypes)
    theirs = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} vs {sorted(theirs)}"]
    for c, t in ours.items():
        if SAME_TYPE.get(t) != theirs[c]:
            problems.append(f"type of {c}: {t} vs {theirs[c]}")
    a = rows_of(df.columns, spark_rows)
    b = rows_of(rel.columns, duck_rows)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        problems.append(f"{len(diff)} rows differ, e.g. {diff[0]}")
    if not a:
        problems.append("no rows")
    return problems


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if args.names and name not in args.names:
            continue
        t0 = time.perf_counter()
        try:
            df = fn(spark, sf_dir)
            if name in catalog.ORACLES:
                problems = compare(df, con, catalog.ORACLES[name])
                verdict = "match"
            else:
                problems = [] if df.count() else ["no rows"]
                verdict = "rows only"
        except Exception as e:  # report and go on with the next query
            problems, verdict = [f"{type(e).__name__}: {str(e)[:1500]}"], ""
        took = time.perf_counter() - t0
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok':5}{name:28}{took:7.2f}s  {'; '.join(problems) or verdict}", flush=True)
    print("all good" if not bad else f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
