"""Append-only graph store in Parquet: logs of nodes and edges, current rows as views over them.

A batch of rows is one write into a folder of its own, so an interrupted write leaves no half batch
behind and readers of older batches are not disturbed.  Upsert, history and time travel are the same
data: a node is its latest row, an edge its first.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE_COLUMNS = ("type", "name", "codebase_id", "content_hash", "last_verified", "parse_confidence", "properties")


def latest_nodes(log: DataFrame) -> DataFrame:
    """Last writer wins on all columns; created_at is the time of the first row of the id.

    ``max_by`` combines in the map tasks, so an id written very often costs one row per task.
    """
    columns = [c for c in NODE_COLUMNS if c in log.columns]
    return (
        log.where(F.col("id").isNotNull()).groupBy("id")
        .agg(F.max_by(F.struct(*columns, F.col("ts").alias("updated_at")), "seq").alias("last"), F.min_by("ts", "seq").alias("created_at"))
        .select("id", *[F.col(f"last.{c}").alias(c) for c in columns], "created_at", F.col("last.updated_at").alias("updated_at"))
    )


def first_edges(edges: DataFrame) -> DataFrame:
    """First writer wins per (src, dst, type): the earliest delivery, those without time last."""
    order = F.struct(F.col("created_at").isNull(), F.col("created_at"), F.coalesce("properties", F.lit("")))
    return (
        edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("type").isNotNull())
        .groupBy("src", "dst", "type").agg(F.min_by(F.struct("properties", "created_at"), order).alias("first"))
        .select("src", "dst", "type", "first.properties", "first.created_at")
    )


def history(log: DataFrame) -> DataFrame:
    """(id, seq, op, content_hash, ts): 'add' for the first row of an id, 'update' for all others."""
    first = log.groupBy("id").agg(F.min("seq").alias("first_seq"))
    return log.join(first, "id").select("id", "seq", F.when(F.col("seq") == F.col("first_seq"), "add").otherwise("update").alias("op"), "content_hash", "ts")


def changed_ids(log: DataFrame, more_than: int = 1) -> DataFrame:
    """(id, n_rows, last_ts) of ids with more than that many rows."""
    return log.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("ts").alias("last_ts")).where(F.col("n_rows") > more_than)


def diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(id, status) of nodes added, removed or changed in content between two sets of nodes."""
    a, b = (df.select("id", F.col("content_hash").alias(h), F.lit(True).alias(f)) for df, h, f in ((new, "h1", "in_new"), (old, "h2", "in_old")))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("h1").eqNullSafe(F.col("h2")), "changed")
    return a.join(b, "id", "full_outer").select("id", status.alias("status")).where(F.col("status").isNotNull())


def codebase_diff(new: DataFrame, old: DataFrame, codebase_id: str) -> DataFrame:
    keep = F.col("codebase_id") == codebase_id
    return diff(new.where(keep), old.where(keep))


class GraphStore:
    """A folder with ``nodes_log`` and ``edges_log``, each a folder of numbered batches.

    A batch is a folder ``batch=<number>-<token>``.  The token names the batch for good: a batch that is
    there as a whole is not written again, one that was left half written is replaced, so a replayed
    write changes nothing.  Writers without a token get one of their own, so two of them never write
    into one folder.  ``seq`` is (number, token, row): the order of batches, then that within a batch.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, rows: DataFrame, log: str, token: str | None) -> None:
        token = token or uuid.uuid4().hex
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{log}")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
        batches = [name.split("=", 1)[1].split("-", 1) for name in names if name.startswith("batch=")]
        mine = [int(number) for number, name in batches if name == token]
        number = mine[0] if mine else 1 + max((int(number) for number, _ in batches), default=-1)
        folder = f"{self.path}/{log}/batch={number}-{token}"
        if mine and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")):
            return
        rows.write.mode("overwrite").parquet(folder)

    def add_nodes(self, nodes: DataFrame, ts=None, token: str | None = None) -> None:
        """Append a batch; rows of a batch keep their order in ``seq``."""
        at = F.lit(ts).cast("timestamp") if ts else F.current_timestamp()
        columns = [F.col(c) if c in nodes.columns else F.lit(None).cast("double" if c == "parse_confidence" else "string").alias(c) for c in NODE_COLUMNS]
        self._write(nodes.select("id", *columns, F.monotonically_increasing_id().alias("row"), at.alias("ts")), "nodes_log", token)

    def add_edges(self, edges: DataFrame, ts=None, token: str | None = None) -> None:
        at = F.lit(ts).cast("timestamp") if ts else F.current_timestamp()
        properties = F.col("properties") if "properties" in edges.columns else F.lit(None).cast("string").alias("properties")
        self._write(edges.select("src", "dst", "type", properties, at.alias("created_at")), "edges_log", token)

    def nodes_log(self) -> DataFrame:
        log = self.spark.read.option("basePath", f"{self.path}/nodes_log").option("partitionColumnTypeInference.enabled", "false").parquet(f"{self.path}/nodes_log")
        batch = F.split(F.col("batch").cast("string"), "-", 2)
        return log.withColumn("seq", F.struct(F.get(batch, F.lit(0)).cast("bigint").alias("batch"), F.get(batch, F.lit(1)).alias("token"), F.col("row"))).drop("batch", "row")

    def nodes(self) -> DataFrame:
        return latest_nodes(self.nodes_log())

    def node(self, id_: str) -> DataFrame:
        return latest_nodes(self.nodes_log().where(F.col("id") == id_))

    def edges(self) -> DataFrame:
        return first_edges(self.spark.read.option("basePath", f"{self.path}/edges_log").parquet(f"{self.path}/edges_log").drop("batch"))

    def history(self) -> DataFrame:
        return history(self.nodes_log())

    def sql(self, query: str) -> DataFrame:
        """Read-only SQL over the views nodes, edges and node_history."""
        self.nodes().createOrReplaceTempView("nodes")
        self.edges().createOrReplaceTempView("edges")
        self.history().createOrReplaceTempView("node_history")
        return read_only_sql(self.spark, query)

    def compact(self, into: str) -> "GraphStore":
        """A new store that holds only current rows, in one batch."""
        fresh = GraphStore(self.spark, into)
        fresh.add_nodes(self.nodes())
        fresh.add_edges(self.edges())
        return fresh


def read_only_sql(spark: SparkSession, query: str) -> DataFrame:
    """Run a SELECT or WITH; anything else is refused (views cannot be written to anyway)."""
    if not re.match(r"\s*(SELECT|WITH)\b", query, re.IGNORECASE):
        raise ValueError("only SELECT and WITH are allowed")
    return spark.sql(query)


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The whole last row per key, by a window (for tables where columns are not known beforehand)."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
