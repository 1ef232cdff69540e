"""Compare every registered query with its SQL on DuckDB: ``python -m workload.check [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

from kpiloom.session import build_session
from workload import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(value, digits: int | None):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, Decimal)):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.{digits}g}") if digits else value
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return str(value)


def rows(columns: list[str], records, digits: int | None = None) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i], digits) for i in order) for r in records)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder: str, query) -> tuple[str, str]:
    """Outcome and detail: ``exact``, ``close`` (equal to 12 digits), ``rows-only`` or ``DIFFERENT``."""
    df = query.run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if query.sql is None:
        return "rows-only", f"{len(got)} rows"
    cursor = con.execute(query.sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return "DIFFERENT", f"columns {sorted(df.columns)} against {sorted(names)}"
    for outcome, digits in (("exact", None), ("close", 12)):
        a, b = rows(df.columns, got, digits), rows(names, want, digits)
        if a == b:
            return outcome, f"{len(got)} rows"
    return "DIFFERENT", f"{len(got)} rows against {len(want)}; {list((a - b))[:3]} against {list((b - a))[:3]}"


def main() -> int:
    args = sys.argv[1:]
    folder = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    wanted = [a for a in args if "/" not in a]
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, query in all_queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            outcome, detail = compare(spark, con, folder, query)
        except Exception as e:  # report and go on with the next query
            outcome, detail = "ERROR", str(e)[:900]
        bad += outcome in ("ERROR", "DIFFERENT")
        print(f"{outcome:10s} {name:40s} {time.time() - start:6.2f}s  {detail}", flush=True)
    print(f"{bad} of {len(all_queries())} need work")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
