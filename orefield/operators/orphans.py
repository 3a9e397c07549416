"""References to records that do not exist.

Edges refer to nodes by ``dst``; nodes refer to their parent by a bare name in ``properties``.  A
reference is an orphan when its key is known nowhere (``missing``), only from the history
(``deleted``), or when its node was recorded after it (``late``).

Plan: references are counted per key and period, with the earliest time of each, and these counts are
written once; everything that follows is decided on them.  Keys that hold a thousandth of all
references or more (so at most a thousand keys) are heavy: the node tables are searched for them by a
broadcast of the keys.  The counts of all other keys are anti-joined with the known keys by a shuffle.
Both give orphan keys, which are united; only references to orphan keys are then expanded, those of
heavy keys by a broadcast of the at most thousand keys and spread by the whole reference, the others
by one shuffle on the key which also serves the removal of repeated deliveries.

Defined cases: a null ``dst`` or parent name is no reference, an empty parent name neither; keys are
compared without letter case and surrounding blanks; repeated deliveries of a reference count once,
at their earliest non-null time; a reference without time is never late; null ids of nodes match
nothing; empty tables give empty results (or only ``missing``, where the node tables are empty);
columns other than the named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.plans.lineage import cut
from orefield.plans.skew import heavy_keys

#: Property that names a parent, and the type of that parent.
PARENTS = {"parent_program": "Program", "parent_copybook": "Copybook", "parent_job": "JCLJob", "parent_table": "DB2Table"}


def match_key(id_: Column) -> Column:
    """An id without letter case and surrounding blanks."""
    return F.upper(F.btrim(id_, F.lit(" \t\r\n")))


def edge_references(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("dst").isNotNull()).select(
        F.lit("edges").alias("ref_table"), F.col("src").alias("from_id"), F.col("dst").alias("ref_id"),
        F.col("type").alias("ref_type"), F.col("created_at").alias("at"),
    )


def parent_references(nodes: DataFrame) -> DataFrame:
    names = F.array(*[
        F.struct(F.lit(prop).alias("prop"), F.lit(kind).alias("kind"), F.get_json_object("properties", f"$.{prop}").alias("name"))
        for prop, kind in PARENTS.items()
    ])
    held = F.filter(names, lambda p: p["name"].isNotNull() & (F.btrim(p["name"], F.lit(" \t\r\n")) != ""))
    return (
        nodes.where(F.col("properties").contains("parent_"))
        .select("id", "codebase_id", "created_at", F.explode(held).alias("p"))
        .select(
            F.lit("nodes").alias("ref_table"), F.col("id").alias("from_id"),
            F.concat(F.col("p.kind"), F.lit(":"), F.coalesce("codebase_id", F.lit("")), F.lit(":"), F.col("p.name")).alias("ref_id"),
            F.col("p.prop").alias("ref_type"), F.col("created_at").alias("at"),
        )
    )


def known_ids(nodes: DataFrame, platform_nodes: DataFrame, history: DataFrame) -> DataFrame:
    """One row per key: since when it is a node, and whether it is one, a platform node, or only known from history."""
    never = F.lit(None).cast(dict(nodes.dtypes)["created_at"])
    parts = [
        nodes.select(match_key(F.col("id")).alias("key"), F.col("created_at").alias("since"), F.lit(2).alias("rank")),
        platform_nodes.select(match_key(F.col("id")).alias("key"), never.alias("since"), F.lit(3).alias("rank")),
        history.select(match_key(F.col("id")).alias("key"), never.alias("since"), F.lit(1).alias("rank")),
    ]
    return (
        reduce(DataFrame.unionByName, parts).where(F.col("key").isNotNull())
        .groupBy("key").agg(F.min("since").alias("since"), F.max("rank").alias("rank"))
    )


def orphans(edges: DataFrame, nodes: DataFrame, platform_nodes: DataFrame, history: DataFrame, *, heavy_rows: int = 100) -> DataFrame:
    """Orphan references: ref_table, from_id, ref_id, ref_type, status, at (time of the reference).

    ``heavy_rows``: references that a key must hold, besides a thousandth of all, to be treated as heavy.
    """
    refs = edge_references(edges).unionByName(parent_references(nodes)).withColumn("key", match_key(F.col("ref_id")))
    known = known_ids(nodes, platform_nodes, history)
    # References per key and period: combined in the map tasks, then small whatever the skew.
    counts = cut(refs.groupBy("key", F.date_trunc("month", "at").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")))
    heavy = heavy_keys(counts, "key", min_rows=heavy_rows, rows="n")
    is_heavy = F.col("key").isin(heavy) if heavy else F.lit(False)
    per_key = counts.groupBy("key").agg(F.min("first").alias("first"))
    never_known, gone, after = F.col("rank").isNull(), F.col("rank") == 1, (F.col("rank") == 2) & (F.col("since") > F.col("first"))

    def orphan_keys(met: DataFrame) -> DataFrame:
        return met.where(never_known | gone | after).select("key", "rank", "since")

    once = ["key", "ref_table", "from_id", "ref_id", "ref_type"]
    status = (
        F.when(F.col("rank").isNull(), "missing")
        .when(F.col("rank") == 1, "deleted")
        .when((F.col("rank") == 2) & (F.col("since") > F.col("at")), "late")
    )
    states = [F.first("rank").alias("rank"), F.first("since").alias("since")]

    def expanded(some: DataFrame, keys: DataFrame) -> DataFrame:
        one = some.join(keys, "key").groupBy(*once).agg(F.min("at").alias("at"), *states)
        return one.withColumn("status", status).where(F.col("status").isNotNull()).select("ref_table", "from_id", "ref_id", "ref_type", "status", "at")

    light_keys = orphan_keys(per_key.where(~is_heavy).join(known, "key", "left"))
    found = expanded(refs.where(~is_heavy), light_keys.hint("shuffle_merge"))
    if heavy:
        hot = F.broadcast(per_key.where(is_heavy))  # at most MAX_KEYS rows
        met = hot.join(known.join(F.broadcast(per_key.where(is_heavy).select("key")), "key", "left_semi"), "key", "left")
        found = found.unionByName(expanded(refs.where(is_heavy), F.broadcast(orphan_keys(met))))
    return found


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, month of the reference and status: first counted per key and month, then over all keys."""
    per_key = found.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("month"), "status", "ref_id").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("ref_table", "month", "status").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_ids"))
