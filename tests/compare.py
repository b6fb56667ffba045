"""Rows of a Spark query and of its SQL on DuckDB, in a comparable form."""

from __future__ import annotations

import datetime
import glob
import math
import os


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, int):
        return v
    return round(float(v), 6)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(plain(r[i])) for i in order) for r in data)), [columns[i] for i in order]


def both(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got, names = rows(df.columns, df.collect())
    con = duck(sf_dir)
    rel = con.execute(sql)
    want, wanted = rows([x[0] for x in rel.description], rel.fetchall())
    return got, names, want, wanted
