"""Compare a Spark result with its DuckDB oracle: row count, column names and
an order-insensitive hash of the values (columns sorted by name)."""

from __future__ import annotations

import hashlib
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == int(v) and abs(v) < 1e15:
            return str(int(v))
        return repr(round(v, 6))
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def digest(cols, rows) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256()
    for ln in lines:
        h.update(ln.encode())
        h.update(b"\n")
    return h.hexdigest()


def compare(spark_df, con, sql):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    match = (len(s_rows) == len(d_rows) and sorted(s_cols) == sorted(d_cols)
             and digest(s_cols, s_rows) == digest(d_cols, d_rows))
    diff = []
    if not match and sorted(s_cols) == sorted(d_cols):
        so = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        do = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        sset = {tuple(_norm(r[i]) for i in so) for r in s_rows}
        dset = {tuple(_norm(r[i]) for i in do) for r in d_rows}
        diff = [("spark", x) for x in sorted(sset - dset)[:5]] + \
               [("duck", x) for x in sorted(dset - sset)[:5]]
    return {
        "diff": diff,
        "rows": (len(s_rows), len(d_rows)),
        "cols": (sorted(s_cols), sorted(d_cols)),
        "match": match,
        "spark_sample": s_rows[:3],
        "duck_sample": d_rows[:3],
    }
