import random
from collections import deque

from orefield.operators import graph as G

N = "id string, type string, name string, codebase_id string, parse_confidence double, properties string"
E = "src string, dst string, type string, properties string"


def make(spark, ids, edges):
    nodes = spark.createDataFrame([(i, "Program", i.upper(), "cb", 1.0, '{"parent_job": "J"}') for i in ids], N)
    return nodes, spark.createDataFrame([(*e, None) for e in edges], E)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def bfs(edges, start, hops):
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        if seen[x] < hops:
            for a, b in edges:
                if a == x and b not in seen:
                    seen[b] = seen[x] + 1
                    queue.append(b)
    return {k: v for k, v in seen.items() if v}


def test_neighbours_dangling_and_loops(spark):
    nodes, edges = make(spark, ["a", "b"], [("a", "b", "CALLS"), ("a", "b", "READS"), ("a", "gone", "CALLS"), ("b", "b", "CALLS")])
    assert [r[:3] for r in rows(G.neighbors(edges, nodes))] == [("a", "CALLS", "b"), ("a", "READS", "b"), ("b", "CALLS", "b")]
    assert len(rows(G.predecessors(edges, nodes, "CALLS"))) == 3
    assert [r[:4] for r in rows(G.touching(edges, nodes)) if r[0] == "b"] == [("b", "CALLS", "in", "a"), ("b", "CALLS", "out", "b"), ("b", "READS", "in", "a")]
    assert rows(G.degrees(edges)) == [("a", 3), ("b", 4), ("gone", 1)]
    assert rows(G.hubs(edges, nodes, 2)) == [("a", "Program", "A", 3), ("b", "Program", "B", 4)]
    assert [r["parent_job"] for r in G.runners(edges, nodes).collect()] == [None, None]
    assert rows(G.without_incoming(nodes, edges, "Program", ["CALLS"])) == [("a", "A", "cb")]
    assert "a -- \"CALLS\" --> b" in {r["id"]: r["diagram"] for r in G.mermaid(edges, nodes).collect()}["a"]


def test_search_equals_brute_force_with_rings(spark):
    rnd = random.Random(5)
    ids = [f"n{i}" for i in range(40)]
    pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(60)] + [("n0", "n1"), ("n1", "n0"), ("n0", "dangling")]
    nodes, edges = make(spark, ids, [(*p, "CALLS") for p in pairs])
    both = pairs + [(b, a) for a, b in pairs]
    starts = nodes.where("id in ('n0', 'n7')")
    got = {(r["start"], r["id"]): r["hop"] for r in G.impact(edges, nodes, starts, 2).collect()}
    assert got == {(s, k): v for s in ("n0", "n7") for k, v in bfs(both, s, 2).items()}
    known = [p for p in both if p[1] in ids]
    got = {(r["start"], r["id"]): r["hop"] for r in G.impact(edges, nodes, starts, 3, dangling=False).collect()}
    assert got == {(s, k): v for s in ("n0", "n7") for k, v in bfs(known, s, 3).items()}
    depth = {r["id"]: r["depth"] for r in G.depth_from_all(edges, nodes, "CALLS").collect()}
    inside = [p for p in pairs if p[1] in ids]
    want = {s: max(bfs(inside, s, 10**6).values(), default=0) for s in {a for a, b in inside}}
    assert depth == {k: v for k, v in want.items() if v}


def test_summary_find_and_empty(spark):
    nodes, edges = make(spark, ["abc", "xabc"], [])
    assert tuple(G.summary(nodes, edges).first()) == (2, 0, 0, "empty")
    assert G.find(nodes, "ABC").first()["id"] == "abc" and G.find(nodes, "bc", "Program").first()["id"] == "abc" and G.find(nodes, "zz").count() == 0
    assert G.closure(edges).count() == 0 and G.hubs(edges, nodes).count() == 0


def test_chains_resolve_through_table_and_event(spark):
    nodes = spark.createDataFrame([("Trigger:cb:T1", "Trigger", "T1", "cb", 1.0, '{"table": "A", "base_event": "INSERT"}'), ("Trigger:cb:T2", "Trigger", "T2", "cb", 1.0, '{"table": "B", "base_event": "UPDATE"}')], N)
    edges = spark.createDataFrame([("Trigger:cb:T1", "Trigger:cb:ON:B:UPDATE", "TRIGGERS_TRIGGER", None), ("Trigger:cb:T1", "DB2Table:cb:A", "FIRES_ON", None)], E)
    assert rows(G.resolved_chains(edges, nodes)) == [("Trigger:cb:T1", "Trigger:cb:T2", "TRIGGERS_TRIGGER")]
    assert rows(G.triggers_on(edges, nodes)) == [("DB2Table:cb:A", "Trigger:cb:T1", "")]


def test_impact_of_many_starts_equals_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("nodes", "platform_nodes", "edges"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in ("impact_2hop_starts", "impact_3hop_starts"):
        got = entry.queries()[name](spark, folder).select("start", "id", "hop", "type", "name")
        assert rows(got) == sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=str)


def test_impact_of_many_equals_brute_force_around_hubs(spark):
    rnd = random.Random(7)
    ids = [f"n{i}" for i in range(60)]
    pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(50)]
    pairs += [(h, rnd.choice(ids)) for h in ("n0", "n1", "n2") for _ in range(9)] + [("n0", "n1"), ("n5", "n5"), ("n6", "gone"), ("n0", "lost"), ("gone", "lost"), ("n6", "gone")]
    nodes, edges = make(spark, ids, [(*p, "CALLS") for p in pairs])
    edges = edges.unionByName(spark.createDataFrame([("n3", None, "CALLS", None)], E))
    both = pairs + [(b, a) for a, b in pairs]
    for hops, dangling, hub_steps, sent in ((2, True, 10, 100), (3, False, 8, 0), (3, True, 6, 100), (3, True, 1000, 0), (1, True, 8, 100), (4, True, 8, 100)):
        known = both if dangling else [p for p in both if p[1] in ids]
        starts = ids[:40:2] + ["n1"]
        asked = spark.createDataFrame([(i,) for i in [*starts, "n4", "alone", None]], "id string")
        got = G.impact_of_many(edges, nodes, asked, hops, dangling, hub_steps=hub_steps, most_sent=sent)
        assert dict(got.dtypes)["hop"] == "bigint"
        want = [(s, k, v, "Program" if k in ids else None, k.upper() if k in ids else None) for s in starts for k, v in bfs(known, s, hops).items()]
        assert rows(got) == sorted(want, key=str), (hops, dangling, hub_steps, sent)


def _wheel(spark, folder, n):
    """n nodes around one hub, each with a neighbour."""
    import datetime

    nodes = spark.range(n + 1).select("id").selectExpr("'Program:cb:NODE' || id AS id", "'Program' AS type", "'N' || id AS name", "'cb' AS codebase_id", "'' AS content_hash", "1.0D AS parse_confidence", "'' AS properties")
    nodes.where("name <> 'N0'").write.parquet(f"{folder}/nodes.parquet")
    nodes.where("name = 'N0'").write.parquet(f"{folder}/platform_nodes.parquet")
    edges = spark.range(1, n + 1).selectExpr("'Program:cb:NODE' || id AS src", f"explode(array('Program:cb:NODE0', 'Program:cb:NODE' || (id % {n} + 1))) AS dst", "'CALLS' AS type", "'' AS properties")
    edges.crossJoin(spark.createDataFrame([(datetime.datetime(2026, 1, 1),)], "created_at timestamp_ntz")).write.parquet(f"{folder}/edges.parquet")


def _kept_by(spark, name, folder):
    """(rows, bytes in the checkpoint folder) of a query on a folder."""
    from pathlib import Path

    import __spark_entry__ as entry
    from orefield.plans.lineage import cut

    cut(spark.range(1))
    kept = lambda: sum(p.stat().st_size for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*") if p.is_file())
    before = kept()
    n = entry.queries()[name](spark, str(folder)).count()
    return n, kept() - before


def test_impact_2hop_starts_keeps_no_pairs_of_a_hub(spark, tmp_path):
    _wheel(spark, tmp_path, 6000)
    n, kept = _kept_by(spark, "impact_2hop_starts", tmp_path)
    assert n > 600_000 and kept < 3_000_000


def test_impact_3hop_starts_keeps_no_pairs_of_a_hub(spark, tmp_path):
    _wheel(spark, tmp_path, 6000)
    n, kept = _kept_by(spark, "impact_3hop_starts", tmp_path)
    assert n > 600_000 and kept < 3_000_000


def test_heights_equal_a_search_from_every_node(spark):
    import random

    from orefield.operators.graph import heights

    rnd = random.Random(5)
    for rings, several in ((False, False), (True, False), (True, True)):
        steps = set()
        for kind in ("A", "B"):
            for i in range(1, 60):
                steps.add((kind, f"n{rnd.randrange(max(0, i - 6), i)}", f"n{i}"))
            if rings:
                steps |= {(kind, "n59", "n0"), (kind, "r1", "r2"), (kind, "r2", "r1"), (kind, "r2", "r3"), (kind, "s", "s"), (kind, "r3", "r4")}
            if several:
                steps |= {(kind, f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(9)}
        want = {}
        for kind in ("A", "B"):
            down = {}
            for k, a, b in steps:
                if k == kind and a != b:
                    down.setdefault(a, set()).add(b)
            for start in down:
                seen, frontier, level = {start}, {start}, 0
                while frontier := {b for a in frontier for b in down.get(a, ())} - seen:
                    seen |= frontier
                    level += 1
                want[kind, start] = level
        df = spark.createDataFrame(sorted(steps), "kind string, src string, dst string")
        assert {(r["kind"], r["id"]): r["depth"] for r in heights(df).collect()} == want
    assert heights(spark.createDataFrame([], "kind string, src string, dst string")).count() == 0
