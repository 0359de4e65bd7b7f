"""Compare registered queries with their SQL counterparts: python tests/oracle_check.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(value):
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return f"{float(value):.9g}" if not isinstance(value, int) else f"{value}"
    return str(value)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def compare(df, con, statement: str) -> str | None:
    """None when equal, else a description of the difference."""
    result = con.execute(statement)
    names = [d[0] for d in result.description]
    kinds = dict(zip(names, [str(d[1]) for d in result.description]))
    theirs = rows_of(names, result.fetchall())
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    expected = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
    }
    off = [(c, t, kinds[c]) for c, t in df.dtypes if expected[t] != kinds[c]]
    if off:
        return f"types differ: {off}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"rows differ: {a} != {b} (columns {sorted(names)})"
    return None if mine else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from tsrisk.session import get_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    spark = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if len(args) > 1 and name not in args[1:]:
            continue
        began = time.time()
        try:
            df = fn(spark, folder)
            problem = compare(df, con, oracle[name]) if name in oracle else f"no oracle, {df.count()} rows"
        except Exception as error:  # report every query, not only the first failure
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem) and name in oracle
        print(f"{name:28s} {time.time() - began:6.2f}s  {problem or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
