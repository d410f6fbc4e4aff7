"""Compare a Spark result with the result of its SQL, as sets of rows with columns sorted by name.

Run as a script to check some queries:  python -m tests.oracle [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def _kind(value) -> str:
    return type(value).__name__


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = [dict(zip(names, r)) for r in cursor.fetchall()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    columns = sorted(names)
    left = Counter(tuple(_plain(r[c]) for c in columns) for r in rows)
    right = Counter(tuple(_plain(r[c]) for c in columns) for r in expected)
    if left != right:
        only_left, only_right = left - right, right - left
        return (
            f"{len(rows)} rows against {len(expected)}; columns {columns}\n"
            f"   only Spark ({sum(only_left.values())}): {list(only_left)[:3]}\n"
            f"   only SQL   ({sum(only_right.values())}): {list(only_right)[:3]}"
        )
    for c in columns:
        kinds = {_kind(r[c]) for r in rows if r[c] is not None} ^ {_kind(r[c]) for r in expected if r[c] is not None}
        if kinds:
            return f"column {c}: types differ {kinds}"
    if not rows:
        return "no rows on either side"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        started = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                label = "ok"
            else:
                problem, label = None, f"rows only: {len(df.collect())}"
        except Exception as exc:  # noqa: BLE001 - a checker reports and goes on
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else label:14} {time.time() - started:6.2f}s {name} {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
