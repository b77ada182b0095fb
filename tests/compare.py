"""Run registered queries beside their SQL in DuckDB: ``python -m tests.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_duckdb(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def spark_result(df):
    return df.columns, [tuple(r) for r in df.collect()]


def duck_result(con, sql: str):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def difference(df, con, sql: str) -> str | None:
    """None when the results agree, else a short description."""
    left_columns, left = spark_result(df)
    right_columns, right = duck_result(con, sql)
    if sorted(left_columns) != sorted(right_columns):
        return f"columns {sorted(left_columns)} != {sorted(right_columns)}"
    a, b = rows_of(left_columns, left), rows_of(right_columns, right)
    kinds = {
        c: (type(next((r[left_columns.index(c)] for r in left if r[left_columns.index(c)] is not None), None)).__name__,
            type(next((r[right_columns.index(c)] for r in right if r[right_columns.index(c)] is not None), None)).__name__)
        for c in left_columns
    }
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if odd:
        return f"types differ (spark, duckdb): {odd}"
    if a != b:
        only_left, only_right = list((a - b).items())[:2], list((b - a).items())[:2]
        return f"{len(left)} vs {len(right)} rows; only spark {only_left}; only duckdb {only_right}"
    return None if left else "both results are empty"


def main(argv: list[str]) -> int:
    from lakeops.checks import ORACLES, QUERIES
    from lakeops.session import build_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = argv[1:] or list(QUERIES)
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = open_duckdb(sf_dir)
    bad = 0
    for name in [n for n in QUERIES if any(n == w or n.startswith(w) for w in names)]:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = difference(df, con, ORACLES[name]) if name in ORACLES else f"(no SQL) {df.count()} rows"
            ok = problem is None or name not in ORACLES
        except Exception as error:
            ok, problem = False, f"{type(error).__name__}: {str(error)[:400]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.2f}s {problem or ''}"[:900], flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
