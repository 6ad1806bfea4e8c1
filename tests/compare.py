"""Run registered queries next to their SQL and compare columns, kinds, rows and values.

``python -m tests.compare [--sf DIR] [--times] [key ...]``
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, Decimal):
        return "decimal"
    if isinstance(value, (dt.date, dt.datetime)):
        return type(value).__name__
    return type(value).__name__


def canon(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, list):
        return tuple(canon(v) for v in value)
    return value


def compare(df, connection, sql: str) -> tuple[bool, str]:
    names = sorted(df.columns)
    got = [tuple(canon(r[c]) for c in names) for r in df.collect()]
    cursor = connection.execute(sql)
    expected_names = [d[0] for d in cursor.description]
    if sorted(expected_names) != names:
        return False, f"columns {sorted(set(expected_names) ^ set(names))}"
    position = [expected_names.index(c) for c in names]
    want = [tuple(canon(r[i]) for i in position) for r in cursor.fetchall()]
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    for i, name in enumerate(names):
        a = {kind(r[i]) for r in got} - {"null"}
        b = {kind(r[i]) for r in want} - {"null"}
        if a != b:
            return False, f"column {name}: kinds {a} vs {b}"
    extra, missing = Counter(got) - Counter(want), Counter(want) - Counter(got)
    if extra or missing:
        text = f"{sum(extra.values())} rows differ of {len(got)}\n   columns {names}"
        for label, rows in (("spark", extra), ("sql", missing)):
            for row in sorted(rows, key=str)[:3]:
                text += f"\n   {label}: {row}"
        return False, text
    return True, f"{len(got)} rows"


def main() -> int:
    import __spark_entry__ as entry
    from skyledger.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("keys", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    options = parser.parse_args()
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(options.sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    unknown = [k for k in sqls if k not in queries]
    bad = list(unknown)
    if unknown:
        print("SQL without a query:", unknown)
    for key in options.keys or queries:
        started = time.time()
        try:
            df = queries[key](spark, options.sf)
            if key in sqls:
                built = time.time()
                ok, text = compare(df, connection, sqls[key])
                text += f" (build {built - started:.1f}s)"
            else:
                ok, text = True, f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            ok, text = False, f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {key} {time.time() - started:.1f}s {text}", flush=True)
        if not ok:
            bad.append(key)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
