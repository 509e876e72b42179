"""Run queries next to their SQL twins and report differences. Usage: oracle_check.py [folder] [names...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def spark_rows(df):
    names = sorted(df.columns)
    return names, [tuple(row) for row in df.select(*[f"`{n}`" for n in names]).collect()]


def duck_rows(con, sql: str):
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], [tuple(row[i] for i in order) for row in result.fetchall()]


def mismatch(left, right) -> str | None:
    """None if both sides hold the same rows, value by value; else a short description."""
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    a, b = Counter(map(repr, left[1])), Counter(map(repr, right[1]))
    if a == b:
        return None
    only_a, only_b = sorted((a - b).elements()), sorted((b - a).elements())
    return f"rows {len(left[1])} / {len(right[1])}; apart {len(only_a)} / {len(only_b)}; {only_a[:2]} / {only_b[:2]}"


def has_nan(rows) -> bool:
    return any(isinstance(v, float) and math.isnan(v) for row in rows for v in row)


def main() -> int:
    import __spark_entry__ as entry
    from flightlens.session import get_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("oracle", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wanted, oracles, bad = sys.argv[2:], entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            left = spark_rows(build(spark, folder))
            took = time.time() - started
            if name not in oracles:
                text = f"rows only {len(left[1])}" + (" (nan)" if has_nan(left[1]) else "")
            else:
                started = time.time()
                problem = mismatch(left, duck_rows(con, oracles[name]))
                text = f"rows {len(left[1])} duck {time.time() - started:.1f}s " + (problem or "ok")
                bad += problem is not None
        except Exception as error:  # noqa: BLE001
            took, bad = time.time() - started, bad + 1
            text = "ERROR " + str(error)[:400]
        print(f"{name:26s} {took:5.1f}s {text}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
