"""Side-by-side comparison of a query and its checking SQL."""

from __future__ import annotations

import math
import os
import time

import duckdb

TESTDATA = os.environ.get("TERRAFLOW_TESTDATA", "/root/testdata")
TIMES: dict[str, float] = {}
TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None:
        return "\0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    """(column problem, row counts, first differing rows)."""
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canon(cur.fetchall(), names)
    TIMES["sql"] = time.time() - start
    got = canon([tuple(r) for r in df.collect()], df.columns)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; got {got[:2]} want {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({sorted(names)}): {bad[:2]}"
    return ""
