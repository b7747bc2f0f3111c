"""Run registered queries next to their SQL twins and compare types and values.

``python tests/compare.py [sf] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def oracle(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.6f}" if value != 0 else "0.000000"
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in rows])


def differences(df, connection, sql: str) -> list[str]:
    """Empty when names, types, row count and values agree."""
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = [str(d[1]) for d in result.description]
    expected = result.fetchall()
    actual = [tuple(r) for r in df.collect()]
    out = []
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    for name, kind in zip(columns, kinds):
        if KINDS.get(kind, kind) != dict(df.dtypes)[name]:
            out.append(f"type of {name}: {dict(df.dtypes)[name]} != {kind}")
    left, right = normal(df.columns, actual), normal(columns, expected)
    if len(left) != len(right):
        out.append(f"rows {len(left)} != {len(right)}")
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first {sorted(columns)}: {wrong[0][0]} != {wrong[0][1]}")
    return out


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans, twins = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(plans)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = plans[name](spark, folder)
            if name in twins:
                found = differences(df, oracle(folder), twins[name])
            else:
                found = [] if df.collect() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        kind = "sql" if name in twins else "rows"
        print(f"{'ok ' if not found else 'BAD'} {name} [{kind}] {time.time() - start:.1f}s", *found, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
