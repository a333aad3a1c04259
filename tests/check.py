"""Compares registered queries with their SQL: row count, columns, sorted values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return str(value)


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    got = spark_df.collect()
    want = con.execute(sql)
    want_names = [d[0] for d in want.description]
    if sorted(spark_df.columns) != sorted(want_names):
        return f"columns {sorted(spark_df.columns)} != {sorted(want_names)}"
    left, right = _sorted_rows(spark_df.columns, got), _sorted_rows(want_names, want.fetchall())
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"first difference over {sorted(want_names)}: {a} != {b}"
    return None


def main() -> int:
    """Usage: check.py SF [QUERY ...]"""
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from touchline.plans.catalog import ORACLES, QUERIES
    from touchline.session import local_session

    sf_dir, wanted = f"/root/testdata/sf{sys.argv[1]}", sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(cores=8), connection(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = compare(df, con, ORACLES[name]) if name in ORACLES else f"rows only: {len(df.collect())}"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None and not problem.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.1f}s  {problem or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
