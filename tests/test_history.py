import random
from datetime import datetime as dt
from datetime import timedelta

from orefield.operators.history import versions

SCHEMA = "seq bigint, id string, content_hash string, op string, ts timestamp_ntz, state string, at bigint, slice int"
ZERO = dt(1970, 1, 1)


def brute(rows):
    out, by = [], {}
    for seq, id_, h, op, ts in rows:
        if id_ is None or ts is None:
            continue
        op, seq = (op or "update").strip().lower(), -(2**63) if seq is None else seq
        by.setdefault(id_, {}).setdefault(ts, {})
        key = (op, h)
        by[id_][ts][key] = min(seq, by[id_][ts].get(key, seq))
    for id_, times in by.items():
        current, n, open_ = None, 0, None
        for ts in sorted(times):
            op, h = max(times[ts], key=lambda k: times[ts][k])
            us = (ts - ZERO) // timedelta(microseconds=1)
            if op == "delete" or (h is not None and h != current):
                if open_:
                    out.append((*open_, us))
                open_ = None
                current = None if op == "delete" else h
                if current is not None:
                    n += 1
                    open_ = (id_, n, us)
        if open_:
            out.append((*open_, -1))
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(tuple(r)[:4] for r in versions(df, **kw).collect())


def test_rules_one_by_one(spark):
    t = [dt(2024, 1, i) for i in range(1, 9)]
    rows = [
        (1, "a", "h1", "add", t[0]), (2, "a", "h1", " Update", t[1]), (3, "a", None, "update", t[2]), (4, "a", "h2", "UPDATE ", t[3]), (5, "a", "h9", "delete", t[4]), (6, "a", "h2", "add", t[5]),
        (7, "b", None, "delete", t[0]), (8, "c", "x", "add", None), (9, None, "x", "add", t[0]), (10, "d", "p", "add", t[0]), (11, "d", "q", "update", t[0]), (12, "d", "p", "add", t[0]),
    ]
    assert run(spark, rows) == brute(rows)
    assert [r[:2] for r in run(spark, rows)] == [("a", 1), ("a", 2), ("a", 3), ("d", 1)]


def test_random_logs_whole_and_in_slices(spark):
    rnd = random.Random(3)
    for _ in range(3):
        rows = [
            (i, rnd.choice(["a", "b", "c", None]), rnd.choice(["x", "y", None]), rnd.choice(["add", "update", "DELETE", None]), rnd.choice([None, *[dt(2024, 1, 1) + timedelta(hours=7 * k) for k in range(25)]]))
            for i in range(120)
        ]
        assert run(spark, rows) == brute(rows) == run(spark, rows, hot_rows=2, slice_us=40 * 3_600_000_000)


def test_empty(spark):
    assert run(spark, []) == []
