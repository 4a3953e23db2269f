"""DuckDB views over the driver tables and a strict result comparison."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return v


def _rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cols = [[_norm(v) for v in df[c].tolist()] for c in df.columns]
    # an integer column with NULLs arrives as float
    cols = [[float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in c] for c in cols]
    return sorted(zip(*cols), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    """Empty when both hold the same rows, exactly; else a short difference."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    ra, rb = _rows(a), _rows(b)
    if len(ra) != len(rb):
        return f"rows {len(ra)} != {len(rb)}"
    diff = [(x, y) for x, y in zip(ra, rb) if x != y]
    return f"{len(diff)} rows differ, first {sorted(a.columns)}: {diff[0]}" if diff else ""
