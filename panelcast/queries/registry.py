"""Registration of queries and small output helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NUDGE = 0.017


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero. The nudge makes values that lie
    exactly halfway, up to summation noise, round the same way everywhere."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(NUDGE * 10.0**-digits), digits) + F.lit(0.0)


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, dates as text."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            out.append(rnd(f.name, special.get(f.name, digits)).alias(f.name))
        elif kind == "date":
            out.append(F.col(f.name).cast("string").alias(f.name))
        elif kind in ("integer", "byte", "short"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
