"""Compare a query with its SQL over one folder of tables."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if x != x else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return float(x) if isinstance(x, decimal.Decimal) else x


def compare(df, sql: str, sf: str) -> None:
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    want = con.sql(sql)
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    rows = lambda it: sorted((tuple(map(plain, r)) for r in it), key=repr)
    assert rows(df.select(*names).collect()) == rows(want.select(*(f'"{n}"' for n in names)).fetchall())
