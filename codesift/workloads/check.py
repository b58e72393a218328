"""Compare registered queries with their SQL, cell by cell."""

from __future__ import annotations

import math
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_cell(v[k])}" for k in sorted(v)) + "}"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), sorted(columns)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, sf_dir: str, name: str, query, sql: str, con=None) -> tuple[bool, str]:
    con = con or duck(sf_dir)
    t0 = time.time()
    df = query(spark, sf_dir)
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want, wcols = rows_of(cols, res.fetchall())
    t2 = time.time()
    note = f"{name}: {len(got)} rows, spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if gcols != wcols:
        return False, f"{note}; columns {gcols} vs {wcols}"
    if got != want:
        a, b = set(got), set(want)
        return False, (f"{note} vs {len(want)}; only spark {len(a - b)} {sorted(a - b)[:2]}; "
                       f"only sql {len(b - a)} {sorted(b - a)[:2]}")
    return True, note
