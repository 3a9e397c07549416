"""Graph operators on nodes (id, type, name, ...) and edges (src, dst, type, ...).

Edges may dangle; whether dangling ends count is said with each operator.  Joins are left to Spark's
planner, which broadcasts what is measured to be small and splits skewed partitions; a hub that a tenth
of all edges point to is thereby spread over several tasks.  Iterations are checkpointed.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions.model import prop
from orefield.plans.lineage import cut
from orefield.plans.skew import heavy_keys

HUB_STEPS = 1000  # a hub takes at least so many steps away, and a thousandth of all
MOST_SENT = 200_000  # rows that are broadcast at most
ROWS_A_TASK = 4_000_000
SLICES = 64  # copies of the starts of hubs where they are too many to be broadcast


def _ends(nodes: DataFrame, id_as: str, *columns: str) -> DataFrame:
    return nodes.select(F.col("id").alias(id_as), *[F.col(c).alias(f"{id_as}_{c}") for c in columns])


def neighbors(edges: DataFrame, nodes: DataFrame, edge_type: str | None = None) -> DataFrame:
    """(src, type, dst, dst_type, dst_name): one row per edge whose destination is a node."""
    e = edges.where(F.col("type") == edge_type) if edge_type else edges
    return e.select("src", "type", "dst").join(_ends(nodes, "dst", "type", "name"), "dst").select("src", "type", "dst", "dst_type", "dst_name")


def predecessors(edges: DataFrame, nodes: DataFrame, edge_type: str | None = None) -> DataFrame:
    """(dst, type, src, src_type, src_name): one row per edge whose source is a node."""
    e = edges.where(F.col("type") == edge_type) if edge_type else edges
    return e.select("src", "type", "dst").join(_ends(nodes, "src", "type", "name"), "src").select("dst", "type", "src", "src_type", "src_name")


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, type, direction, other, other_type, other_name) over both directions; a loop counts once."""
    out = neighbors(edges, nodes).select(F.col("src").alias("id"), "type", F.lit("out").alias("direction"), F.col("dst").alias("other"), F.col("dst_type").alias("other_type"), F.col("dst_name").alias("other_name"))
    into = predecessors(edges.where(F.col("src") != F.col("dst")), nodes).select(F.col("dst").alias("id"), "type", F.lit("in").alias("direction"), F.col("src").alias("other"), F.col("src_type").alias("other_type"), F.col("src_name").alias("other_name"))
    return out.unionByName(into)


def runners(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What runs each program: steps that execute and programs that call it, steps with their job."""
    programs = nodes.where(F.col("type") == "Program").select(F.col("id").alias("dst"), F.col("name").alias("program"))
    by = nodes.select(F.col("id").alias("src"), F.col("type").alias("runner_type"), F.col("name").alias("runner"), prop("parent_job").alias("parent_job"))
    return (
        edges.where(F.col("type").isin("EXECUTES", "CALLS")).select("src", "dst", "type")
        .join(programs, "dst").join(by, "src")
        .select("dst", "program", "type", "src", "runner_type", "runner", F.when(F.col("type") == "EXECUTES", F.col("parent_job")).alias("parent_job"))
    )


def triggers_on(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(table_id, trigger_id, chain): triggers that fire on each table, with the triggers each of them sets off."""
    fires = edges.where(F.col("type") == "FIRES_ON").select(F.col("src").alias("trigger_id"), F.col("dst").alias("table_id"))
    known = nodes.select(F.col("id").alias("trigger_id"), F.lit(True).alias("known"))
    chain = neighbors(edges, nodes, "TRIGGERS_TRIGGER").groupBy(F.col("src").alias("trigger_id")).agg(F.array_join(F.array_sort(F.collect_set("dst_name")), ",").alias("chain"))
    return fires.join(known, "trigger_id").join(chain, "trigger_id", "left").select("table_id", "trigger_id", F.coalesce("chain", F.lit("")).alias("chain"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): in and out, a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(edges: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """The k ids of highest degree, those that are nodes with name and type; dangling ids take up places too."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(k)
    return nodes.join(F.broadcast(top), "id").select("id", "type", "name", "degree")


def counts_by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, logical units (paragraphs) and health."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("type") == "Paragraph").alias("n_units"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    one = lambda df: df.withColumn("__one", F.lit(1))  # noqa: E731  # one row on either side
    return one(n).join(one(e), "__one").select("n_nodes", "n_edges", "n_units", F.when(F.col("n_edges") == 0, "empty").otherwise("stable").alias("health"))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(steps: DataFrame, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """(start, id, hop): ids reached from each start over (src, dst), with the least number of steps; starts themselves are left out.

    ``hops`` limits the search; without it the search ends when nothing new is found, rings included.
    """
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hop"))
    frontier, found, k = seen, [], 0
    while hops is None or k < hops:
        k += 1
        new = frontier.select("start", F.col("id").alias("src")).join(steps, "src").select("start", F.col("dst").alias("id")).distinct().join(seen, ["start", "id"], "left_anti")
        frontier = cut(new.withColumn("hop", F.lit(k)))
        if frontier.isEmpty():
            break
        found.append(frontier)
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def impact(edges: DataFrame, nodes: DataFrame, starts: DataFrame, hops: int = 2, dangling: bool = True) -> DataFrame:
    """(start, id, hop, type, name): everything within ``hops`` undirected steps; without ``dangling`` the search passes nodes only."""
    steps = both_ways(edges)
    if not dangling:
        steps = steps.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    return reach(steps, starts, hops).join(nodes.select("id", "type", "name"), "id", "left").select("start", "id", F.col("hop").cast("bigint").alias("hop"), "type", "name")


def impact_of_many(edges: DataFrame, nodes: DataFrame, starts: DataFrame, hops: int = 2, dangling: bool = True, *, hub_steps: int = HUB_STEPS, most_sent: int = MOST_SENT) -> DataFrame:
    """The rows of ``impact`` for starts by the thousand, whose pairs (start, id) may be too many to be shuffled or kept.

    Nearly all pairs run through a few hubs (at most 1000, see ``heavy_keys``).  Those pairs are not made before the
    result: an id keeps how far it is behind each hub, a hub which starts are how far from it, and each id meets the
    starts of its hubs as it is written.  Only pairs with a way around the hubs are searched, gathered by id and told apart
    from the others there.  Ids are shuffled as hashes, with a seed under which no two of them have the same.
    """
    edges, starts = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst"), starts.where(F.col("id").isNotNull()).select("id").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    seed, loose = _hashed(nodes.select("id"), ends.unionByName(starts))
    v = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    steps = edges.select(v("src").alias("src"), v("dst").alias("dst")).where("src <> dst")
    steps = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    if not dangling:
        steps = steps.join(nodes.select(v("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    steps = cut(steps)
    begun = cut(starts.select(F.monotonically_increasing_id().alias("s"), F.col("id").alias("start"), v("id").alias("v")))
    hubs = heavy_keys(steps, "src", min_rows=hub_steps)
    around, away = steps.where(~F.col("src").isin(hubs)), steps.where(F.col("src").isin(hubs))

    # From starts to all ids (themselves with 0), and from hubs to all ids, with no hub between.
    pairs = _walks([begun.select("s", "v")], around, hops, most_sent)
    # Without a start that is a hub, a step to a hub is spent before one leads away from it.
    left = hops if hubs and not begun.where(F.col("v").isin(hubs)).isEmpty() else hops - 1
    at_hubs = away.select(F.col("src").alias("s"), F.col("src").alias("v")).distinct()
    behind = _walks([at_hubs, cut(away.select(F.col("src").alias("s"), F.col("dst").alias("v")))], around, left, most_sent)
    behind = cut(behind.groupBy(F.col("s").alias("h"), "v").agg(F.min("l").alias("d")).where("d > 0"))
    before = cut(_before(pairs, behind, hubs, hops))

    # Tasks by the number of rows of the result.
    here = {(r["h"], r["d"]): r["count"] for r in before.groupBy("h", "d").count().collect()}
    there = behind.where(~F.col("v").isin(hubs)).groupBy("h", "d").count().collect()
    rows = sum(r["count"] * n for r in there for (h, d), n in here.items() if h == r["h"] and d + r["d"] <= hops)
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, rows // ROWS_A_TASK))

    named = nodes.where(F.col("id").isNotNull()).select(v("id").alias("v"), "id", "type", "name")
    if dangling:
        named = named.unionByName(loose, allowMissingColumns=True)
    by_id = lambda df: df.repartition(parts, "v")
    near = by_id(pairs.where(~F.col("v").isin(hubs))).groupBy("v", "s").agg(F.min("l").alias("l")).groupBy("v").agg(F.collect_list(F.col("s") * (hops + 1) + F.col("l")).alias("near"))
    refs = by_id(behind.where(~F.col("v").isin(hubs))).groupBy("v").agg(F.collect_list(F.struct("h", "d")).alias("refs"))
    ids = by_id(named).join(refs, "v", "left").join(near, "v", "left").where("refs IS NOT NULL OR near IS NOT NULL")

    of_start = before.groupBy("s").agg(F.collect_list(F.struct("h", F.col("d").alias("to"))).alias("hubs"))
    who = cut(begun.select("s", "start").join(of_start, "s", "left"))
    of_hub = before.where(F.col("d") < hops).withColumnRenamed("d", "to").join(who, "s")

    # Pairs with a way around the hubs: one through a hub may be shorter.
    code = hops + 1
    through = F.array_min(F.flatten(F.transform("refs", lambda r: F.transform(F.filter("hubs", lambda x: x["h"] == r["h"]), lambda x: x["to"] + r["d"]))))
    direct = ids.select("id", "type", "name", "refs", F.explode("near").alias("p")).select("id", "type", "name", "refs", F.expr(f"p div {code}").alias("s"), (F.col("p") % code).alias("l")).where("l > 0")
    direct = direct.join(F.broadcast(who) if begun.count() <= most_sent else who, "s").select("start", "id", F.least("l", through).alias("hop"), "type", "name")

    # All others: each id with the starts of its hubs.
    apart = F.coalesce(F.transform("near", lambda p: F.call_function("div", p, F.lit(code))), F.array().cast("array<bigint>"))
    met = ids.where("refs IS NOT NULL").select("id", "type", "name", "refs", apart.alias("near"), F.explode("refs").alias("r")).select("id", "type", "name", "refs", "near", "r.h", "r.d")
    met = met.withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), hops - F.col("d"))))
    if before.count() <= most_sent:
        met = met.join(F.broadcast(of_hub), ["h", "to"])
    else:
        of_hub = of_hub.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        met = met.withColumn("slice", F.pmod(F.hash("id"), F.lit(SLICES))).repartition(parts, "h", "to", "slice").join(of_hub.repartition(parts, "h", "to", "slice").hint("shuffle_hash"), ["h", "to", "slice"])
    hop, h = F.col("to") + F.col("d"), F.col("h")
    met = met.where(~F.array_contains("near", F.col("s")))
    if len(hubs) > 1:
        better = F.exists("refs", lambda r: F.exists("hubs", lambda x: (x["h"] == r["h"]) & ((x["to"] + r["d"] < hop) | ((x["to"] + r["d"] == hop) & (x["h"] < h)))))
        met = met.where(~((F.size("refs") > 1) & (F.size("hubs") > 1) & better))
    met = met.select("start", "id", hop.alias("hop"), "type", "name")

    onto = before.where("d > 0").join(who, "s").join(named.where(F.col("v").isin(hubs)).withColumnRenamed("v", "h"), "h").select("start", "id", F.col("d").alias("hop"), "type", "name")
    return direct.unionByName(met).unionByName(onto) if hubs else direct


def _hashed(known: DataFrame, ids: DataFrame) -> tuple[int, DataFrame]:
    """The first seed under which no two ids have the same hash, and (v, id) of the ids that are not known."""
    rows = known.where(F.col("id").isNotNull()).withColumn("known", F.lit(True)).unionByName(ids.withColumn("known", F.lit(False)))
    for seed in count():
        by_hash = rows.groupBy(F.xxhash64(F.lit(seed), "id").alias("v")).agg(F.min("id").alias("id"), F.max("id").alias("other"), F.max("known").alias("known"))
        odd = cut(by_hash.where("id <> other OR NOT known"))
        if odd.where("id <> other").isEmpty():
            return seed, odd.select("v", "id")
    raise AssertionError


def _walks(found: list[DataFrame], steps: DataFrame, hops: int, most_sent: int) -> DataFrame:
    """(s, v, l): ends of walks of l steps, at most ``hops``, going on from ``found`` = ends after 0, 1, ... steps; every end comes with its least l, and of the last step again with others."""
    found = [df.withColumn("l", F.lit(k).cast("bigint")) for k, df in enumerate(found)]
    while len(found) <= hops:
        k, front = len(found), found[-1].select("s", F.col("v").alias("src"))
        if k > 1 and front.count() <= most_sent:
            front = F.broadcast(front)
        new = steps.join(front, "src").select("s", F.col("dst").alias("v"))
        if k < hops:
            for df in found:
                new = new.join(df.select("s", "v"), ["s", "v"], "left_anti")
            new = cut(new.distinct())
        found.append(new.withColumn("l", F.lit(k).cast("bigint")))
    rows = found[0]
    for df in found[1 : hops + 1]:
        rows = rows.unionByName(df)
    return rows


def _before(pairs: DataFrame, behind: DataFrame, hubs: list, hops: int) -> DataFrame:
    """(h, s, d): the distance of each start to each hub, over other hubs too."""
    least = lambda df: df.groupBy("h", "s").agg(F.min("d").alias("d"))
    known = least(pairs.where(F.col("v").isin(hubs)).select(F.col("v").alias("h"), "s", F.col("l").alias("d")))
    if len(hubs) > 1:
        between = behind.where(F.col("v").isin(hubs)).select("h", F.col("v").alias("next"), F.col("d").alias("more"))
        for _ in range(hops):
            on = known.join(between, "h").select(F.col("next").alias("h"), "s", (F.col("d") + F.col("more")).alias("d")).where(F.col("d") <= hops)
            known = cut(least(known.unionByName(on)))
    return known


def closure(steps: DataFrame) -> DataFrame:
    """(start, id, hop): all that each node reaches over (src, dst), with the least number of steps; a node does not reach itself.

    Distances are joined with themselves, so the number of rounds is the logarithm of the longest one.
    After a round all distances up to twice the former limit are known and least; a round that finds no
    new pair therefore proves that there is none.
    """
    known = steps.where(F.col("src") != F.col("dst")).select(F.col("src").alias("start"), F.col("dst").alias("id"), F.lit(1).cast("bigint").alias("hop")).distinct()
    known = cut(known)
    n, before = known.count(), -1
    while n != before:
        far = known.select(F.col("start").alias("id"), F.col("id").alias("next"), F.col("hop").alias("more"))
        longer = known.join(far, "id").where(F.col("start") != F.col("next")).select("start", F.col("next").alias("id"), (F.col("hop") + F.col("more")).alias("hop"))
        known = cut(known.unionByName(longer).groupBy("start", "id").agg(F.min("hop").alias("hop")))
        n, before = known.count(), n
    return known


def heights(steps: DataFrame) -> DataFrame:
    """(kind, id, depth) of every node with a step down: levels of a breadth-first search from it, over (kind, src, dst).

    Where every node has at most one step up, what is below a node is a tree: heights are carried to the
    ancestor 1, 2, 4, ... steps above, one row per node and round, so the work is that of the nodes times
    the logarithm of the longest chain.  Pointers that never end lie on rings or below them; for the nodes
    on rings alone distances along the ring are added.  Kinds in which a node has several steps up need all
    pairs (``closure``).
    """
    steps = cut(steps.where(F.col("src") != F.col("dst")).distinct())
    many = [r["kind"] for r in steps.groupBy("kind", "dst").count().where("count > 1").select("kind").distinct().collect()]
    tangled = steps.where(F.col("kind").isin(many)) if many else None
    if many:
        steps = steps.where(~F.col("kind").isin(many))
    up = steps.select("kind", F.col("dst").alias("id"), F.col("src").alias("above"))
    known = steps.select("kind", F.col("src").alias("id")).distinct().withColumn("depth", F.lit(1).cast("bigint"))
    # Targets are the nodes with something so far below them: fewer each round, until only nodes on rings are left.
    targets = lambda: up.select("kind", "above").distinct().count()
    n, before, reach_ = targets(), None, 1
    while n and n != before:
        carried = up.join(known, ["kind", "id"], "left").select("kind", F.col("above").alias("id"), (F.coalesce("depth", F.lit(0)) + reach_).alias("depth"))
        known = cut(known.unionByName(carried).groupBy("kind", "id").agg(F.max("depth").alias("depth")))
        up = cut(up.join(up.select("kind", F.col("id").alias("above"), F.col("above").alias("further")), ["kind", "above"]).select("kind", "id", F.col("further").alias("above")))
        n, before, reach_ = targets(), n, 2 * reach_
    if n:
        known = _around_rings(steps, up.select("kind", F.col("above").alias("id")).distinct(), known)
    if tangled is not None:
        pairs = closure(tangled.select(_of_kind("src").alias("src"), _of_kind("dst").alias("dst")))
        far = pairs.groupBy("start").agg(F.max("hop").alias("depth"))
        known = known.unionByName(far.select(F.substring_index("start", "\u0001", 1).alias("kind"), F.substr("start", F.instr("start", F.lit("\u0001")) + 1).alias("id"), "depth"))
    return known


def _of_kind(end: str) -> Column:
    return F.concat("kind", F.lit("\u0001"), end)


def _around_rings(steps: DataFrame, ring: DataFrame, known: DataFrame) -> DataFrame:
    """Heights again for nodes on rings: the farthest of all ring nodes, each with the tree that hangs on it."""
    ring = cut(ring)
    on = ring.select("kind", F.col("id").alias("src"))
    within = steps.join(on, ["kind", "src"], "left_semi").join(ring.select("kind", F.col("id").alias("dst")), ["kind", "dst"], "left_semi")
    hanging = steps.join(on, ["kind", "src"], "left_semi").join(ring.select("kind", F.col("id").alias("dst")), ["kind", "dst"], "left_anti")
    tree = hanging.join(known.select("kind", F.col("id").alias("dst"), "depth"), ["kind", "dst"], "left").groupBy("kind", F.col("src").alias("id")).agg(F.max(F.coalesce("depth", F.lit(0)) + 1).alias("tree"))
    pairs = closure(within.select(_of_kind("src").alias("src"), _of_kind("dst").alias("dst")))
    name = lambda c: F.substr(c, F.instr(c, F.lit("\u0001")) + 1)
    pairs = pairs.select(F.substring_index("start", "\u0001", 1).alias("kind"), name("start").alias("start"), name("id").alias("id"), "hop").unionByName(ring.select("kind", F.col("id").alias("start"), "id", F.lit(0).cast("bigint").alias("hop")))
    far = pairs.join(tree, ["kind", "id"], "left").groupBy("kind", F.col("start").alias("id")).agg(F.max(F.col("hop") + F.coalesce("tree", F.lit(0))).alias("depth"))
    return known.join(ring, ["kind", "id"], "left_anti").unionByName(far)


def depths(edges: DataFrame, nodes: DataFrame, edge_types: Sequence[str], alone: bool = False) -> DataFrame:
    """(kind, id, depth) per edge type: levels of a breadth-first search from every node that has such an edge; destinations must be nodes.

    Nodes that reach nothing but themselves are left out, or come with depth 0 if ``alone``.
    """
    steps = edges.where(F.col("type").isin(*edge_types)).select(F.col("type").alias("kind"), "src", "dst")
    steps = steps.join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("kind", "src", "dst")
    found = heights(steps)
    if not alone:
        return found
    loops = steps.where(F.col("src") == F.col("dst")).select("kind", F.col("src").alias("id")).distinct().join(found, ["kind", "id"], "left_anti")
    return found.unionByName(loops.withColumn("depth", F.lit(0).cast("bigint")))


def depth_from_all(edges: DataFrame, nodes: DataFrame, edge_type: str, alone: bool = False) -> DataFrame:
    """(id, depth) along one edge type."""
    return depths(edges, nodes, [edge_type], alone).select("id", "depth")


def resolved_chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """TRIGGERS_TRIGGER edges whose destination is a placeholder ``...:ON:table:event``, led on to the triggers of that table and event."""
    place = F.split(F.col("dst"), ":")
    waiting = edges.where((F.col("type") == "TRIGGERS_TRIGGER") & (F.get(place, F.lit(2)) == "ON")).select("src", F.get(place, F.lit(1)).alias("codebase_id"), F.upper(F.get(place, F.lit(3))).alias("table"), F.upper(F.get(place, F.lit(4))).alias("event"))
    triggers = nodes.where(F.col("type") == "Trigger").select(F.col("id").alias("dst"), "codebase_id", F.upper(prop("table")).alias("table"), F.upper(prop("base_event")).alias("event"))
    return waiting.join(triggers, ["codebase_id", "table", "event"]).select("src", "dst", F.lit("TRIGGERS_TRIGGER").alias("type"))


def without_incoming(nodes: DataFrame, edges: DataFrame, node_type: str, edge_types: Sequence[str]) -> DataFrame:
    """Nodes of a type to which no edge of these types points."""
    aimed = edges.where(F.col("type").isin(*edge_types)).select(F.col("dst").alias("id"))
    return nodes.where(F.col("type") == node_type).join(aimed, "id", "left_anti").select("id", "name", "codebase_id")


def find(nodes: DataFrame, asked: str, node_type: str | None = None) -> DataFrame:
    """The node that a name means: an exact name or id first, then the first that contains it; one row or none."""
    n = nodes.where(F.col("type") == node_type) if node_type else nodes
    q = asked.lower()
    tier = F.when((F.lower("name") == q) | (F.col("id") == asked), 1).when(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("id"), F.lit(q)), 2)
    return n.withColumn("tier", tier).where(F.col("tier").isNotNull()).orderBy("tier", "id").limit(1).drop("tier")


def mermaid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, diagram): for every node a Mermaid drawing of its neighbourhood."""
    line = F.concat(F.lit("  "), F.regexp_replace("id", r"[^A-Za-z0-9]", "_"), F.lit(" -- \""), F.col("type"), F.lit("\" --> "), F.regexp_replace("other", r"[^A-Za-z0-9]", "_"))
    return touching(edges, nodes).select("id", line.alias("line")).groupBy("id").agg(F.concat(F.lit("graph LR\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("diagram"))
