"""Compare a query with its SQL: the same columns and, in any order, the same rows."""

from __future__ import annotations

import datetime
import math

import duckdb

from vacantia.sources.tables import TABLES


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> tuple[bool, str]:
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want == got:
        return True, f"{len(got[1])} rows"
    if want[0] != got[0]:
        return False, f"columns {got[0]} for {want[0]}"
    gone, more = [r for r in want[1] if r not in set(got[1])][:2], [r for r in got[1] if r not in set(want[1])][:2]
    return False, f"{len(got[1])} rows for {len(want[1])}; missing {str(gone)[:300]}; extra {str(more)[:300]}"
