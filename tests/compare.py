"""Results of queries and of their SQL, compared as sorted rows."""

from __future__ import annotations

import math
import os

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if type(v).__name__ in ("Decimal", "float", "float64", "float32"):
        f = float(v)
        return str(int(f)) if f == math.floor(f) and abs(f) < 1e15 else f"{f:.6g}"
    if isinstance(v, int) or "int" in type(v).__name__:
        return str(int(v))
    return str(v)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def of_spark(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows(df.columns, df.collect())


def of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows(columns, cur.fetchall())
