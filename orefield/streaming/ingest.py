"""Incremental ingestion: new source files become rows of the graph store as they arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orefield.operators.extract import extract, merged_edges, merged_nodes
from orefield.sources.store import GraphStore

SOURCE_FILES = "source_file string, text string, codebase_id string, artifact_type string, n_bytes bigint, scanned_at timestamp"


def arriving_files(spark: SparkSession, folder: str, schema: str = SOURCE_FILES) -> DataFrame:
    """A stream of the Parquet files of source text that are put into ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def into_store(files: DataFrame, store: GraphStore, checkpoint: str) -> StreamingQuery:
    """Extract every batch of arriving files and append its nodes and edges; ends when all files that are there are done.

    A batch is stored under the name of the stream (its checkpoint folder) and its number, so one that is
    replayed after a failure is not stored twice.
    """
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def append(batch: DataFrame, number: int) -> None:
        made = extract(batch)
        store.add_nodes(merged_nodes(made.nodes), token=f"{stream}.{number}")
        store.add_edges(merged_edges(made.edges), token=f"{stream}.{number}")

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(events: DataFrame, late_by: str = "10 minutes", window: str = "5 minutes", by: str = "event_type", ts: str = "ts") -> DataFrame:
    """Counts per window of event time and kind, with a watermark; works on streams and on tables."""
    return events.withWatermark(ts, late_by).groupBy(F.window(ts, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
