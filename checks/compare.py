"""Runs every query and its SQL, and reports where they differ.

python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

from checks import oracles, queries
from watchloom.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return "ok"
    diff = next(((a, b) for a, b in zip(got, want) if a != b), None)
    return f"rows {len(got)} vs {len(want)}; first difference {str(diff)[:900]}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                   "spark.driver.memory": "8g", "spark.log.level": "ERROR",
                                   "spark.ui.showConsoleProgress": "false"}
    )
    con = connect(sf_dir)
    sql = oracles.all_sql()
    bad = 0
    for name, run in queries.bound().items():
        if wanted and name not in wanted:
            continue
        began = time.monotonic()
        try:
            df = run(spark, sf_dir)
            outcome = compare(df, con, sql[name]) if name in sql else f"rows {df.count()} (no SQL)"
        except Exception as failure:
            outcome = f"FAILED {type(failure).__name__}: {str(failure)[:1500]}"
        bad += not (outcome == "ok" or "no SQL" in outcome)
        print(f"{name:28s} {time.monotonic() - began:6.2f}s  {outcome}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
