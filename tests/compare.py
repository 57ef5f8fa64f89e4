"""Spark rows against DuckDB rows of the same tables, without regard to order."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def duck(folder: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        x = float(value)
        return "nan" if math.isnan(x) else round(x, 6)
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(df, con, sql):
    cursor = con.execute(sql)
    expected = cursor.fetchall()
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    found = rows(df.columns, df.collect())
    wanted = rows(names, expected)
    assert len(found) == len(wanted)
    assert found == wanted
