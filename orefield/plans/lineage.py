"""Cutting lineage so that a lost executor never costs a whole iteration."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's reliable checkpoint folder and go on from the files.

    The folder is the one named by ``spark.checkpoint.dir``.  Where the session names none, a local
    session takes a temporary folder of this machine; on a cluster that would not be seen by all, so it
    is an error.  Sessions that set ``spark.cleaner.referenceTracking.cleanCheckpoints`` have the files
    removed with the DataFrames that hold them.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)
