"""Run a registered Spark query and its DuckDB oracle SQL on the same parquet
tables and compare them order-insensitively (columns sorted by name)."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5) + 0.0
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(_norm(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows(tbl) -> list[tuple]:
    cols = sorted(tbl.column_names)
    data = [tbl.column(c).to_pylist() for c in cols]
    out = [tuple(_norm(col[i]) for col in data) for i in range(tbl.num_rows)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def _close(a, b) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5)
    return a == b


def compare(spark, name: str, sf_dir: str, queries: dict, sql: dict):
    sdf = queries[name](spark, sf_dir)
    a = sdf.toArrow()
    b = duck(sf_dir).execute(sql[name]).to_arrow_table()
    ca, cb = sorted(a.column_names), sorted(b.column_names)
    if ca != cb:
        return False, f"columns differ: {ca} vs {cb}"
    ra, rb = rows(a), rows(b)
    if len(ra) != len(rb):
        return False, f"row count {len(ra)} vs {len(rb)}"
    bad = [(x, y) for x, y in zip(ra, rb) if not _close(x, y)]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. {bad[0]}"
    return True, f"{len(ra)} rows"
