"""The narration cache as an append-only log: the last put of a hash counts, with the marks set after it.

A log row is (content_hash, op, payload, human_verified, ts, seq); op is ``put``, ``verify`` or ``stale``.
Marks of a hash that was never put change nothing; a new put clears ``stale`` and overwrites the time
and the mark of verification.  The state is one aggregation that combines in the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def puts(rows: DataFrame, hash_: Column, payload: Column, verified: Column, ts: Column, seq: Column) -> DataFrame:
    """Log rows that put a payload under a hash."""
    return rows.select(hash_.alias("content_hash"), F.lit("put").alias("op"), payload.alias("payload"), verified.alias("human_verified"), ts.alias("ts"), seq.alias("seq"))


def marks(rows: DataFrame, hash_: Column, op: str, ts: Column, seq: Column) -> DataFrame:
    """Log rows that mark a hash as verified (``verify``) or ``stale``."""
    if op not in ("verify", "stale"):
        raise ValueError(op)
    return rows.select(hash_.alias("content_hash"), F.lit(op).alias("op"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("boolean").alias("human_verified"), ts.alias("ts"), seq.alias("seq"))


def narrations(log: DataFrame) -> DataFrame:
    """(content_hash, payload, created_at, human_verified, stale): the state after all rows of the log."""
    of = lambda op: F.when(F.col("op") == op, F.col("seq"))
    state = (
        log.where(F.col("content_hash").isNotNull()).groupBy("content_hash")
        .agg(
            F.max_by(F.struct("payload", "human_verified", "ts"), of("put")).alias("put"), F.max(of("put")).alias("put_seq"),
            F.max(of("verify")).alias("verify_seq"), F.max(of("stale")).alias("stale_seq"),
        ).where(F.col("put_seq").isNotNull())
    )
    later = lambda c: F.coalesce(F.col(c) > F.col("put_seq"), F.lit(False))
    return state.select(
        "content_hash", F.col("put.payload").alias("payload"), F.col("put.ts").alias("created_at"),
        (F.coalesce(F.col("put.human_verified"), F.lit(False)) | later("verify_seq")).alias("human_verified"), later("stale_seq").alias("stale"),
    )
