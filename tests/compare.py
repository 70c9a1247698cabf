"""Runs queries against their SQL twins: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
TABLES += ["documents", "pages", "benchmark", "labels"]


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if value != value else repr(value)
    return str(value)


def normal_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in rows:
        cells = (r[i] for i in order)
        out.append(tuple(_plain(float(c) if hasattr(c, "as_tuple") else c) for c in cells))
    return sorted(out, key=lambda t: tuple((c is None, c or "") for c in t))


def compare(spark, con, name: str, query, sql: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, folder)
    mine = normal_rows(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = normal_rows(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    import __spark_entry__ as e
    from tillwise.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("compare", "local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(folder), e.oracle_sql(), 0
    for name, query in e.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, query, sqls[name], folder)
            else:
                rows = query(spark, folder).collect()
                problem = None if rows else "no rows"
                print("   ", rows[:2])
        except Exception as ex:  # noqa: BLE001
            problem = f"{type(ex).__name__}: {str(ex)[:600]}"
        failed += problem is not None
        print(f"{name:34s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
