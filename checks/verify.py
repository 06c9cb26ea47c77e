"""Run every query against its SQL and report differences: ``python -m checks.verify [folder] [names...]``."""

from __future__ import annotations

import decimal
import sys
import time

import duckdb

from billcycle.session import build_session
from checks.oracle import oracle_sql
from checks.spark_queries import queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return repr(value)
    return str(value)


def normalised(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def sql_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def difference(spark, folder: str, name: str) -> str | None:
    df = queries()[name](spark, folder)
    mine = normalised(df.columns, df.collect())
    columns, rows = sql_rows(folder, oracle_sql()[name])
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(set(columns) ^ set(df.columns))}"
    theirs = normalised(columns, rows)
    if mine == theirs:
        return None
    only_mine, only_theirs = sorted(set(mine) - set(theirs)), sorted(set(theirs) - set(mine))
    return f"rows {len(mine)} / {len(theirs)}; e.g. {sorted(columns)}\n  spark {only_mine[:2]}\n  sql   {only_theirs[:2]}"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "verify",
        "local[8]",
        {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false",
         "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in sys.argv[2:] or queries():
        started = time.time()
        try:
            found = difference(spark, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:700]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - started:.1f}s {found or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
