"""Skew handling: find the few keys that hold many rows and treat them apart.

A heavy key is one that holds at least ``max(min_rows, total / max_keys)`` rows, so there are never
more than ``max_keys`` of them, whatever the size of the input.  That bound is what makes it safe to
hold them on the driver and to broadcast their match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_KEYS = 1000
MIN_ROWS = 100_000


def heavy_keys(df: DataFrame, key: str | Column, *, min_rows: int = MIN_ROWS, max_keys: int = MAX_KEYS, rows: str | None = None) -> list:
    """The keys of ``df`` with at least ``max(min_rows, total / max_keys)`` rows: at most ``max_keys`` values.

    ``rows`` names a column that says for how many rows a row of ``df`` stands.  The count is
    pre-aggregated in each map task before it is shuffled.  Null keys are never heavy.
    """
    col = F.col(key) if isinstance(key, str) else key
    weighed = df.select(col.alias("__key"), (F.col(rows) if rows else F.lit(1)).alias("__rows"))
    counted = weighed.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.sum("__rows").alias("count"))
    top = counted.where(F.col("count") >= min_rows).orderBy(F.desc("count")).limit(max_keys).collect()
    if not top:
        return []
    least = max(min_rows, weighed.agg(F.sum("__rows")).first()[0] / max_keys)
    return [r["__key"] for r in top if r["count"] >= least]


def lookup_join(rows: DataFrame, table: DataFrame, key: str, heavy: list, how: str = "left") -> DataFrame:
    """Join ``rows`` with ``table`` (one row per key, all columns but the key new) on ``key``.

    Rows of heavy keys meet their match by broadcast (at most one table row per heavy key, so the
    size is bounded by ``MAX_KEYS`` rows); all other rows are shuffled on the key.
    """
    if not heavy:
        return rows.join(table, key, how)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    light = rows.where(~is_heavy).join(table.where(~is_heavy), key, how)
    hot = rows.where(is_heavy).join(F.broadcast(table.where(is_heavy)), key, how)
    return light.unionByName(hot)
