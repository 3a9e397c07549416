"""Parent-child links to full hierarchies: path, depth, root and descendants of every node, and rings.

Every child points to one parent, so the links form a pointer graph.  Splitters are chosen by a hash
of the id (and where very many children share a parent, that parent is one too).  Every node walks to
its next splitter or root by pointer doubling; splitters then form a graph smaller by the factor
``every``, which is solved in the same way; each node's answer is its walk plus that of its splitter.

A walk is known to be endless when a round of doubling ends no walk although some are open: a longest
open walk of finite length always ends others.  Endless walks (rings without splitter) and splitters
that never reach a root make up the cyclic part; there, doubling the pointer until the number of
different targets stays the same leaves exactly the nodes on rings as targets.

Each round is checkpointed, so that a lost executor costs one round at most.

Defined cases: links with a null end are skipped; repeated links count once; if a child has several
parents (broken data), the least one counts; a node that is its own parent is a ring of one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.plans.lineage import cut
from orefield.plans.skew import heavy_keys, lookup_join

#: Edge types whose source is the parent, and those whose destination is.
SRC_IS_PARENT = ("CASCADES_TO", "TRIGGERS_TRIGGER")
DST_IS_PARENT = ("DERIVED_FROM",)


def parent_links(edges: DataFrame) -> DataFrame:
    """(edge_type, id, parent), one row per type and child."""
    down = F.col("type").isin(*SRC_IS_PARENT)
    return (
        edges.where(F.col("type").isin(*SRC_IS_PARENT, *DST_IS_PARENT) & F.col("src").isNotNull() & F.col("dst").isNotNull())
        .select(F.col("type").alias("edge_type"), F.when(down, F.col("dst")).otherwise(F.col("src")).alias("id"), F.when(down, F.col("src")).otherwise(F.col("dst")).alias("parent"))
        .groupBy("edge_type", "id").agg(F.min("parent").alias("parent"))
    )


def _key(type_: str, id_: str) -> Column:
    return F.concat(F.col(type_), F.lit("\u0001"), F.col(id_))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _chase(walks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Double the pointers of (key, target, dist, path, open) until no open walk ends any more.

    Returns ended walks and, if there are any, endless ones.  A walk whose target is not among the
    keys has nowhere to go on: its ``dist`` becomes null.
    """
    ended, running = [walks.where(~F.col("open"))], walks.where("open")
    n, before = running.count(), None
    while n and n != before:
        table = _union([*ended, running]).select(
            F.col("key").alias("target"), F.col("target").alias("t2"), F.col("dist").alias("d2"), F.col("path").alias("p2"), F.col("open").alias("o2"),
        )
        running = cut(
            running.join(table, "target", "left").select(
                "key", F.coalesce("t2", "target").alias("target"), (F.col("dist") + F.col("d2")).alias("dist"), F.concat("path", "p2").alias("path"), F.coalesce("o2", F.lit(False)).alias("open"),
            )
        )
        ended.append(running.where(~F.col("open")))
        running = running.where("open")
        n, before = running.count(), n
    return _union(ended), running if n else None


def _on_rings(pointers: DataFrame) -> DataFrame:
    """Keys on rings, of (key, target) in which every target is a key."""
    n, before = pointers.select("target").distinct().count(), None
    while n != before:
        far = pointers.select(F.col("key").alias("target"), F.col("target").alias("t2"))
        pointers = cut(pointers.join(far, "target").select("key", F.col("t2").alias("target")))
        n, before = pointers.select("target").distinct().count(), n
    return pointers.select(F.col("target").alias("key")).distinct()


def hierarchies(links: DataFrame, *, every: int = 8, with_path: bool = False, heavy_rows: int = 100_000) -> DataFrame:
    """(edge_type, id, root_id, depth, path): one row per type and end of a link.

    ``every``: one node in so many is a splitter.  ``path`` runs from the root to the node, both
    included; it is null unless asked for, and on and below rings.  On a ring root_id is ``cycle`` and
    depth -1, below one ``cycle`` and -2.
    """
    links = cut(links.select(_key("edge_type", "id").alias("key"), _key("edge_type", "parent").alias("parent")))
    heavy = heavy_keys(links, "parent", min_rows=heavy_rows)
    children = links.select(F.col("key").alias("parent"), F.lit(True).alias("parent_is_child"))
    is_splitter = lambda c: (F.pmod(F.xxhash64(c), F.lit(every)) == 0) | (c.isin(heavy) if heavy else F.lit(False))
    none = F.lit(None).cast("array<string>")
    path = F.array("key") if with_path else none
    start = lookup_join(links, children, "parent", heavy).withColumn("at_root", F.col("parent_is_child").isNull())
    start = cut(start.select("key", F.col("parent").alias("target"), F.lit(1).cast("bigint").alias("dist"), path.alias("path"), "at_root"))
    # 1. Every node walks to its next splitter or root.
    walks = start.select("key", "target", "dist", "path", (~F.col("at_root") & ~is_splitter(F.col("target"))).alias("open"))
    walked, endless = _chase(walks)
    walked = cut(walked)
    # 2. The graph of the splitters alone.
    roots = start.where("at_root").select(F.col("target").alias("key")).distinct()
    at_root = walked.join(roots.select(F.col("key").alias("target"), F.lit(True).alias("at_root")), "target", "left").withColumn("at_root", F.col("at_root").isNotNull())
    at_root = cut(at_root.select("key", "target", "dist", "path", "at_root"))
    reduced = at_root.where(is_splitter(F.col("key"))).select("key", "target", "dist", "path", (~F.col("at_root")).alias("open"))
    solved, circling = _chase(reduced)
    solved = solved.where(F.col("dist").isNotNull()).select(F.col("key").alias("target"), F.col("target").alias("root"), F.col("dist").alias("d2"), F.col("path").alias("p2"))
    # 3. Each node's walk plus that of its splitter.
    through = lookup_join(at_root.where("not at_root").drop("at_root"), solved, "target", heavy)
    trees = [
        roots.select("key", F.col("key").alias("root"), F.lit(0).cast("bigint").alias("depth"), (F.array("key") if with_path else none).alias("path")),
        at_root.where("at_root").select("key", F.col("target").alias("root"), F.col("dist").alias("depth"), F.reverse(F.concat("path", F.array("target"))).alias("path")),
        through.where(F.col("root").isNotNull()).select("key", "root", (F.col("dist") + F.col("d2")).alias("depth"), F.reverse(F.concat("path", "p2", F.array("root"))).alias("path")),
    ]
    # 4. What reaches no root is on or below a ring.
    lost = through.where(F.col("root").isNull()).select("key")
    if endless is not None:
        lost = lost.unionByName(endless.select("key"))
    rings: list[DataFrame] = []
    if endless is not None or circling is not None:
        pointers = cut(links.join(lost, "key").select("key", F.col("parent").alias("target")))
        ring = _on_rings(pointers).withColumn("ring", F.lit(True))
        rings = [
            pointers.join(ring, "key", "left").select(
                "key", F.lit("\u0001cycle").alias("root"), F.when(F.col("ring"), -1).otherwise(-2).cast("bigint").alias("depth"), none.alias("path"),
            )
        ]
    name = lambda c: F.substr(F.col(c), F.instr(F.col(c), F.lit("\u0001")) + 1)
    return _union([*trees, *rings]).select(
        F.substring_index("key", "\u0001", 1).alias("edge_type"), name("key").alias("id"), name("root").alias("root_id"), "depth",
        F.transform("path", lambda x: F.substr(x, F.instr(x, F.lit("\u0001")) + 1)).alias("path"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """(edge_type, ancestor_id, id, distance): every node under every node above it, from paths."""
    return (
        tree.where(F.col("depth") > 0)
        .select("edge_type", "id", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth").cast("int"))).alias("at", "ancestor_id"))
        .select("edge_type", "ancestor_id", "id", (F.col("depth") - F.col("at")).alias("distance"))
    )
