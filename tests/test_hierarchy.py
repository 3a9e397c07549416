import random

import pytest

from orefield.operators.hierarchy import descendants, hierarchies, parent_links

E = "src string, dst string, type string, key string, depth int"


def brute(parent):
    ends = set(parent) | set(parent.values())
    out = {}
    for x in ends:
        path, at = [x], x
        while at in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        if at not in parent:
            out[x] = (at, len(path) - 1, tuple(reversed(path)))
        else:
            out[x] = ("cycle", -1 if parent[at] == x else -2, None)
    return out


def run(spark, pairs, kind="CASCADES_TO", **kw):
    df = spark.createDataFrame([((p, c) if kind != "DERIVED_FROM" else (c, p)) + (kind, "k", 1) for c, p in pairs], E)
    tree = hierarchies(parent_links(df), **kw)
    return tree, {r["id"]: (r["root_id"], r["depth"], tuple(r["path"]) if r["path"] else None) for r in tree.collect()}


@pytest.mark.parametrize("every", [1, 3, 1000])
def test_random_forests_with_rings(spark, every):
    rnd = random.Random(every)
    parent = {}
    for i in range(1, 160):
        parent[f"n{i}"] = f"n{max(0, i - rnd.randint(1, 4))}"
    for a, b in (("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("s", "s"), ("t0", "r1"), ("t1", "t0"), ("u", "s")):
        parent[a] = b
    _, got = run(spark, [*parent.items(), ("n5", parent["n5"])], with_path=True, every=every, heavy_rows=5)
    assert got == brute(parent)


def test_types_are_apart_and_null_ends_are_skipped(spark):
    df = spark.createDataFrame([("a", "b", "CASCADES_TO", "", 1), ("a", "b", "DERIVED_FROM", "", 1), ("a", None, "TRIGGERS_TRIGGER", "", 1), (None, "b", "CASCADES_TO", "", 1), ("a", "z", "CALLS", "", 1)], E)
    got = sorted((r["edge_type"], r["id"], r["root_id"], r["depth"]) for r in hierarchies(parent_links(df)).collect())
    assert got == [("CASCADES_TO", "a", "a", 0), ("CASCADES_TO", "b", "a", 1), ("DERIVED_FROM", "a", "b", 1), ("DERIVED_FROM", "b", "b", 0)]


def test_descendants_and_empty(spark):
    tree, _ = run(spark, [("b", "a"), ("c", "b")], with_path=True)
    assert sorted((r["ancestor_id"], r["id"], r["distance"]) for r in descendants(tree).collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert run(spark, [])[1] == {}
