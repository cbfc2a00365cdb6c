"""Compare registered queries with their SQL in DuckDB: ``python -m skysweep.checks.compare FOLDER [KEY ...]``."""

from __future__ import annotations

import math
import sys
import time

import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set threads = 8")
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float) or type(value).__name__.startswith("float"):
        return None if math.isnan(value) else float(value)
    if type(value).__name__.startswith(("int", "uint")):
        return int(value)
    if type(value).__name__ in ("bool", "bool_"):
        return bool(value)
    if type(value).__name__ == "ndarray" or isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(map(_plain, row)) for row in df[columns].itertuples(index=False)), key=repr)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when the two results hold the same rows, else a short account of the first difference."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = rows_of(left), rows_of(right)
    bad = [(p, q) for p, q in zip(a, b) if p != q]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {sorted(left.columns)} {bad[0][0]} / {bad[0][1]}"
    types = []
    for name in left.columns:
        mine, other = str(left[name].dtype), str(right[name].dtype)
        if mine != other and not {mine, other} <= {"object", "str", "string"}:
            types.append(f"{name} {mine}/{other}")
    return f"types differ: {', '.join(types)}" if types else None


def main(folder: str, keys: list[str]) -> int:
    from skysweep.checks.all import QUERIES, SQL
    from skysweep.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wanted = [k for k in QUERIES if not keys or any(k == p or (p.endswith("*") and k.startswith(p[:-1])) for p in keys)]
    failures = 0
    for key in wanted:
        started = time.time()
        try:
            mine = QUERIES[key](spark, folder).toPandas()
        except Exception as error:  # report and go on with the other queries
            failures += 1
            print(f"FAIL {key}: {str(error)[:600]}", flush=True)
            continue
        took = time.time() - started
        print(f"     {key} ran {took:.1f}s", flush=True)
        if key not in SQL:
            print(f"rows {key}: {len(mine)} rows {took:.1f}s", flush=True)
            continue
        started = time.time()
        try:
            other = con.execute(SQL[key]).fetchdf()
        except Exception as error:
            failures += 1
            print(f"FAIL {key}: sql {str(error)[:600]}", flush=True)
            continue
        sql_took = time.time() - started
        problem = difference(mine, other)
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {key}: {len(mine)} rows {took:.1f}s sql {sql_took:.1f}s {problem or ''}", flush=True)
    print(f"{failures} failures of {len(wanted)}")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
