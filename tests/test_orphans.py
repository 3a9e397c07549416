from datetime import datetime as dt

from orefield.operators.orphans import orphan_counts, orphans

N = "id string, type string, name string, codebase_id string, properties string, created_at timestamp_ntz, key string, at string"
E = "src string, dst string, type string, properties string, created_at timestamp_ntz, status string"
H = "seq bigint, id string, rank int"


def nodes(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], N)


def run(spark, edges, ns, platform=(), history=(), **kw):
    found = orphans(spark.createDataFrame([(*e, "s") for e in edges], E), nodes(spark, ns), nodes(spark, platform), spark.createDataFrame([(i, h, 0) for i, h in enumerate(history)], H), **kw)
    return sorted(tuple(r)[:5] for r in found.collect())


T1, T2, T3 = dt(2024, 1, 1), dt(2024, 2, 1), dt(2024, 3, 1)
BASE = [("Program:a:P", "Program", "P", "a", None, T2), ("Field:a:C.F", "Field", "C.F", "a", '{"parent_copybook" : "C"}', T1), ("Dataset:a:D", "Dataset", "D", "a", '{"dds": ["X', T1)]


def test_all_states(spark):
    edges = [
        ("s", " program:A:p ", "CALLS", None, T1),  # recorded later
        ("s", "Program:a:P", "CALLS", None, T3),  # fine
        ("s", "Program:a:P", "READS", None, None),  # no time: never late
        ("s", "Program:a:Q", "CALLS", None, T1), ("s", "Program:a:Q", "CALLS", "{}", T3),  # delivered twice
        ("s", "Program:a:GONE", "CALLS", None, T1), ("s", None, "CALLS", None, T1), ("s", "Program:platform:V", "CALLS", None, T1), ("s", "", "CALLS", None, None),
    ]
    got = run(spark, edges, BASE, [("Program:platform:V", "Program", "V", "platform", None, T3)], ["program:a:gone ", "Program:a:P", None])
    assert got == sorted([
        ("edges", "s", " program:A:p ", "CALLS", "late"), ("edges", "s", "Program:a:Q", "CALLS", "missing"), ("edges", "s", "Program:a:GONE", "CALLS", "deleted"),
        ("edges", "s", "", "CALLS", "missing"), ("nodes", "Field:a:C.F", "Copybook:a:C", "parent_copybook", "missing"),
    ])


def test_repeats_count_at_their_earliest_time(spark):
    assert run(spark, [("s", "Program:a:P", "CALLS", None, T3), ("s", "Program:a:P", "CALLS", None, T1), ("s", "Program:a:P", "CALLS", None, None)], BASE[:1]) == [("edges", "s", "Program:a:P", "CALLS", "late")]


def test_heavy_keys_take_the_other_way_to_the_same_result(spark):
    edges = [(f"s{i}", "Program:a:P" if i % 3 else f"Program:a:X{i}", "CALLS", None, T1 if i % 2 else T3) for i in range(300)] * 2
    assert run(spark, edges, BASE, heavy_rows=5) == run(spark, edges, BASE) != []


def test_empty_tables_and_counts(spark):
    assert run(spark, [], []) == []
    assert run(spark, [("s", "X", "CALLS", None, T1)], []) == [("edges", "s", "X", "CALLS", "missing")]
    found = orphans(spark.createDataFrame([("s", "X", "CALLS", None, T1, ""), ("t", "X", "CALLS", None, T1, "")], E), nodes(spark, []), nodes(spark, []), spark.createDataFrame([], H))
    assert [tuple(r) for r in orphan_counts(found).collect()] == [("edges", "2024-01", "missing", 2, 1)]
