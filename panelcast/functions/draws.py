"""Seeded pseudo-random draws that depend on a key only.

``rand(seed)`` changes with the partitioning; a hash of the key does not, so a
re-run after losing an executor returns the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def draw_int(n: Column, *parts: Column | str | int) -> Column:
    """Uniform integer in [0, n) from the first 32 bits of the key's md5."""
    head = F.conv(F.substring(draw_key(*parts), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, n.cast("bigint"))
