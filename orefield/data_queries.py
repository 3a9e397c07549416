"""Registered queries of the core data problems (p2, p4, p5) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.operators import hierarchy, history, orphans
from orefield.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*(table(spark, d, t) for t in ("edges", "nodes", "platform_nodes", "node_history")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("at")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.versions(table(spark, d, "node_history")).drop("state")


def p4_by_slice(spark: SparkSession, d: str) -> DataFrame:
    """The same with few rows needed for an id to be cut into slices of a week, so that the way of hot ids is taken on any table."""
    return history.versions(table(spark, d, "node_history"), hot_rows=10, slice_us=7 * 86_400_000_000).drop("state")


def p4_changes_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Versions begun per codebase and month, and how many of them still hold."""
    v = history.versions(table(spark, d, "node_history"))
    return v.groupBy(
        F.element_at(F.split("id", ":", 3), 2).alias("codebase_id"), F.date_format(F.timestamp_micros("valid_from"), "yyyy-MM").alias("month"),
    ).agg(F.count(F.lit(1)).alias("n_versions"), F.count_if(F.col("valid_to") == -1).alias("n_valid"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchies(hierarchy.parent_links(table(spark, d, "edges"))).drop("path")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.hierarchies(hierarchy.parent_links(table(spark, d, "edges")), with_path=True)
    return tree.select("edge_type", "id", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchies(hierarchy.parent_links(table(spark, d, "edges")), with_path=True))


_KEY = "upper(trim({}, ' ' || chr(9) || chr(10) || chr(13)))"
_ORPHANS = f"""
WITH refs AS (
  SELECT 'edges' AS ref_table, src AS from_id, dst AS ref_id, type AS ref_type, min(created_at) AS t_
  FROM edges WHERE dst IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'nodes', id, p.kind || ':' || codebase_id || ':' || p.name, p.prop, min(created_at)
  FROM (SELECT id, codebase_id, created_at, unnest([
      {{'prop': 'parent_program', 'kind': 'Program', 'name': j ->> 'parent_program'}},
      {{'prop': 'parent_copybook', 'kind': 'Copybook', 'name': j ->> 'parent_copybook'}},
      {{'prop': 'parent_job', 'kind': 'JCLJob', 'name': j ->> 'parent_job'}},
      {{'prop': 'parent_table', 'kind': 'DB2Table', 'name': j ->> 'parent_table'}}]) AS p
    FROM (SELECT *, try_cast(properties AS json) AS j FROM nodes))
  WHERE p.name IS NOT NULL AND trim(p.name) <> '' GROUP BY ALL
), n AS (SELECT {_KEY.format('id')} AS k, min(created_at) AS since FROM nodes GROUP BY 1),
p AS (SELECT DISTINCT {_KEY.format('id')} AS k FROM platform_nodes),
h AS (SELECT DISTINCT {_KEY.format('id')} AS k FROM node_history),
judged AS (
  SELECT refs.*, CASE WHEN p.k IS NOT NULL THEN NULL WHEN n.k IS NOT NULL THEN CASE WHEN n.since > refs.t_ THEN 'late' END
    WHEN h.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS status
  FROM refs LEFT JOIN n ON n.k = {_KEY.format('refs.ref_id')} LEFT JOIN p ON p.k = {_KEY.format('refs.ref_id')} LEFT JOIN h ON h.k = {_KEY.format('refs.ref_id')}
)"""
_VERSIONS = """
WITH rows_ AS (
  SELECT id, epoch_us(ts) AS t_, content_hash AS v, lower(trim(coalesce(op, 'update'))) AS op, min(seq) AS seq
  FROM node_history WHERE ts IS NOT NULL AND id IS NOT NULL GROUP BY ALL
), last_ AS (
  SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY id, t_ ORDER BY seq DESC) = 1
), said AS (
  SELECT id, t_, CASE WHEN op <> 'delete' THEN v END AS state FROM last_ WHERE op = 'delete' OR v IS NOT NULL
), starts AS (
  SELECT * FROM said QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY id ORDER BY t_)
), spans AS (
  SELECT *, coalesce(lead(t_) OVER (PARTITION BY id ORDER BY t_), -1) AS valid_to FROM starts
), versions AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY t_) AS version_no, t_ AS valid_from, valid_to FROM spans WHERE state IS NOT NULL
)"""
_TREE = """
WITH RECURSIVE links AS (
  SELECT type AS edge_type, CASE WHEN type = 'DERIVED_FROM' THEN src ELSE dst END AS id,
    min(CASE WHEN type = 'DERIVED_FROM' THEN dst ELSE src END) AS parent
  FROM edges WHERE type IN ('CASCADES_TO', 'TRIGGERS_TRIGGER', 'DERIVED_FROM') AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2
), ends AS (SELECT edge_type, id FROM links UNION SELECT edge_type, parent FROM links),
tree AS (
  SELECT edge_type, id, id AS root_id, 0::bigint AS depth, [id] AS path FROM ends ANTI JOIN links USING (edge_type, id)
  UNION ALL
  SELECT l.edge_type, l.id, t.root_id, t.depth + 1, list_append(t.path, l.id) FROM tree t JOIN links l ON l.edge_type = t.edge_type AND l.parent = t.id
), lost AS (SELECT edge_type, id, parent FROM links ANTI JOIN tree USING (edge_type, id)),
walk AS (
  SELECT edge_type, id AS start, parent AS t_ FROM lost
  UNION
  SELECT w.edge_type, w.start, l.parent FROM walk w JOIN lost l ON l.edge_type = w.edge_type AND l.id = w.t_
), ring AS (SELECT DISTINCT edge_type, start AS id FROM walk WHERE start = t_)"""
_WHOLE_TREE = """
  SELECT edge_type, id, root_id, depth, path FROM tree
  UNION ALL
  SELECT lost.edge_type, lost.id, 'cycle', CASE WHEN ring.id IS NULL THEN -2 ELSE -1 END, NULL
  FROM lost LEFT JOIN ring ON ring.edge_type = lost.edge_type AND ring.id = lost.id"""

QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p4_found": p4_found,
    "p4_by_slice": p4_by_slice,
    "p4_changes_by_month": p4_changes_by_month,
    "p5_found": p5_found,
    "p5_paths": p5_paths,
    "p5_descendants": p5_descendants,
}

SQL: dict[str, str] = {
    "p2_found": f"{_ORPHANS} SELECT ref_table, from_id, ref_id, ref_type, status FROM judged WHERE status IS NOT NULL",
    "p2_counts": f"{_ORPHANS} SELECT ref_table, strftime(t_, '%Y-%m') AS month, status, count(*) AS n_refs, count(DISTINCT ref_id) AS n_ids FROM judged WHERE status IS NOT NULL GROUP BY 1, 2, 3",
    "p4_found": f"{_VERSIONS} SELECT id, version_no, valid_from, valid_to FROM versions",
    "p4_by_slice": f"{_VERSIONS} SELECT id, version_no, valid_from, valid_to FROM versions",
    "p4_changes_by_month": f"{_VERSIONS} SELECT split_part(id, ':', 2) AS codebase_id, strftime(make_timestamp(valid_from), '%Y-%m') AS month, count(*) AS n_versions, count(*) FILTER (valid_to = -1) AS n_valid FROM versions GROUP BY 1, 2",
    "p5_found": f"{_TREE} SELECT edge_type, id, root_id, depth FROM ({_WHOLE_TREE})",
    "p5_paths": f"{_TREE} SELECT edge_type, id, root_id, depth, array_to_string(path, ' > ') AS path FROM ({_WHOLE_TREE})",
    "p5_descendants": f"{_TREE} SELECT edge_type, path[i] AS ancestor_id, id, depth + 1 - i AS distance FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM tree)",
}
