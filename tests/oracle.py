"""Run a query and its SQL counterpart and compare names, types and rows."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def connect(folder: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, datetime.date):
        return str(v)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(df, connection, sql: str) -> int:
    found = connection.execute(sql)
    names, types = [d[0] for d in found.description], {d[0]: str(d[1]).upper() for d in found.description}
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, df.collect())
    assert got == rows_of(names, found.fetchall())
    for f in df.schema:
        simple = f.dataType.simpleString()
        assert types[f.name] == TYPES.get(simple, simple.upper()), f.name
    return len(got)
