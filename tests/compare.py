"""Runs a registered query and its SQL counterpart and compares rows, columns and values."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads=4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def kind_of(t: str) -> str:
    t = t.lower()
    return {"long": "bigint", "string": "varchar", "timestamp_ntz": "timestamp", "int": "integer"}.get(t, t)


def check(spark, con, name, build, sql, folder):
    t0 = time.time()
    df = build(spark, folder)
    rows = df.collect()
    took = time.time() - t0
    cols = sorted(df.columns)
    mine = sorted(([_plain(r[c]) for c in cols] for r in rows), key=repr)
    if sql is None:
        return took, len(rows), None
    t0 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]).lower() for d in cur.description}
    theirs_raw = cur.fetchall()
    sql_took = time.time() - t0
    if sorted(names) != cols:
        return took, len(rows), f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted(([_plain(r[i]) for i in at] for r in theirs_raw), key=repr)
    for f in df.schema.fields:
        if kind_of(f.dataType.simpleString()) != kind_of(types[f.name]):
            return took, len(rows), f"type of {f.name}: {f.dataType.simpleString()} vs {types[f.name]}"
    if len(mine) != len(theirs):
        return took, len(rows), f"rows {len(mine)} vs {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return took, len(rows), f"cols {cols}\n  spark {str(a)[:600]}\n  sql   {str(b)[:600]}"
    if sql_took > 20:
        return took, len(rows), f"sql slow {sql_took:.1f}s"
    return took, len(rows), None
