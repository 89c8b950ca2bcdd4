"""Run the registered queries and their SQL side by side.

    python tools/check.py [folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from evalweave.queries import QUERIES, SQL
from evalweave.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


def compare(spark, con, name: str, folder: str) -> str:
    """Empty when equal, else what differs."""
    df = QUERIES[name](spark, folder)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        return "" if got[1] else "no rows"
    cur = con.execute(SQL[name])
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} vs {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            diff = [(c, x, y) for c, x, y in zip(got[0], a, b) if x != y or type(x) is not type(y)]
            return f"values {str(diff)[:600]}"
    spark_kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (k, kinds[c]) for c, k in df.dtypes if c in kinds and spark_kinds.get(k, kinds[c]) != kinds[c]}
    return f"types only {odd}" if odd else ""


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("check", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names:
        began = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception:
            problem = "error " + traceback.format_exc()[-1500:]
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - began:6.2f}s {name} {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
