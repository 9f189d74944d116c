"""Comparison of a query with its SQL on the same tables, as bags of rows with columns in name order."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return int(x) if hasattr(x, "is_integer") or type(x).__name__ in ("Decimal", "bool") else x


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir: str, run, sql: str) -> str:
    df = run(spark, sf_dir)
    want = connect(sf_dir).sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} {sorted(want.columns)}"
    a, b = bag(df.columns, df.collect()), bag(want.columns, want.fetchall())
    if a == b:
        return "" if a else "empty"
    return f"{a.total()} and {b.total()} rows; only here {list((a - b).items())[:2]}; only there {list((b - a).items())[:2]}"
