"""Reading a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp column.

    A timestamp without zone is taken as it reads, in whatever zone the session is.
    """
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        return F.unix_micros(F.from_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone()))
    return F.unix_micros(F.col(name).cast("timestamp"))
