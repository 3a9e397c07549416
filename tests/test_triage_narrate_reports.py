import json
import random

import pytest
from pyspark.sql import functions as F

from orefield.functions.text import content_hash, redact
from orefield.operators import narrate as M
from orefield.operators import reports as R
from orefield.operators import triage as T

N = "id string, type string, name string, codebase_id string, content_hash string, parse_confidence double, properties string"
E = "src string, dst string, type string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def graph(spark):
    ns = [
        ("Program:c:A", "Program", "A", "c", "", 1.0, '{"cyclomatic_complexity": 4}'), ("Program:c:B", "Program", "B", "c", "", 0.4, '{"cyclomatic_complexity": 100, "external_calls": ["x", "y"]}'),
        ("Paragraph:c:A.P", "Paragraph", "A.P", "c", "", 1.0, '{"parent_program": "A", "cyclomatic_complexity": 6, "goto_density": 0.75}'), ("Paragraph:c:A.Q", "Paragraph", "A.Q", "c", "", None, '{"parent_program": "A"}'),
        ("DB2Table:c:T", "DB2Table", "T", "c", "", 1.0, None), ("DB2Table:c:U", "DB2Table", "U", "c", "", 1.0, "{broken"),
        ("Copybook:c:K", "Copybook", "K", "c", "", 1.0, None), ("Field:c:K.F", "Field", "K.F", "c", "", 1.0, '{"parent_copybook": "K"}'),
        ("JCLStep:c:S1", "JCLStep", "S1", "c", "", 1.0, '{"parent_job": "J"}'), ("JCLStep:c:S2", "JCLStep", "S2", "c", "", 1.0, '{"parent_job": "J"}'),
    ]
    es = [("Program:c:A", "Program:c:B", "CALLS"), ("Program:c:A", "Program:c:GONE", "CALLS"), ("Program:c:A", "Paragraph:c:A.P", "PERFORMS"), ("Program:c:A", "DB2Table:c:T", "READS"), ("Program:c:A", "Copybook:c:K", "INCLUDES"), ("DB2Table:c:T", "DB2Table:c:U", "CASCADES_TO"), ("JCLStep:c:S2", "Program:c:A", "EXECUTES")]
    return spark.createDataFrame(ns, N), spark.createDataFrame(es, E)


def test_risk(spark):
    nodes, edges = graph(spark)
    risk = {r["id"]: r["risk"] for r in T.scored(nodes, edges).collect()}
    assert risk["Program:c:A"] == 2.0 and risk["Program:c:B"] == 6.0 and risk["Paragraph:c:A.P"] == 3.15 and risk["DB2Table:c:T"] == 0.5 and risk["Paragraph:c:A.Q"] == 0
    assert tuple(T.risk_bands(T.scored(nodes, edges)).first()) == (1, 2, 1)
    assert [r["id"] for r in T.top_risks(T.scored(nodes, edges), 2).orderBy(F.desc("risk")).collect()] == ["Program:c:B", "Paragraph:c:A.P"]


def greedy(items, budget, threshold):
    left, out = budget, []
    for i, r, t in sorted(items, key=lambda x: (-x[1], x[0])):
        if r >= threshold and t <= left:
            left -= t
            out.append((i, r, t))
    return sorted(out, key=str)


def test_budget_equals_greedy_brute_force(spark):
    rnd = random.Random(2)
    for _ in range(3):
        items = [(f"i{i}", float(rnd.randint(0, 9)), rnd.choice([1, 2, 3, 5, 40])) for i in range(200)]
        df = spark.createDataFrame(items, "node_id string, risk double, tokens bigint")
        assert rows(T.within_budget(df, 50, 3.0)) == greedy(items, 50, 3.0)
    assert rows(T.within_budget(df.limit(0), 50)) == []


def test_duplicates_changes_and_candidates(spark):
    u = spark.createDataFrame([(1, "a \nb"), (2, "a\nb\n"), (3, "c"), (4, None)], "unit_id bigint, source string")
    assert sorted((r["n_units"], r["first_unit"]) for r in T.duplicates(u).collect()) == [(1, 3), (2, 1)]
    known = spark.createDataFrame([("n1", "h1"), ("n2", None)], "id string, content_hash string")
    assert rows(T.unit_changes(spark.createDataFrame([("n1", "h1"), ("n2", "x"), ("n3", "y")], "node_id string, content_hash string"), known)) == [("n1", "unchanged"), ("n2", "changed"), ("n3", "added")]
    p = spark.createDataFrame([("p1", "A"), ("p2", "B"), ("p3", "C"), ("p4", "D"), ("p5", "")], "id string, source string")
    h = {r["source"]: r["h"] for r in p.select("source", content_hash(redact(F.col("source"))).alias("h")).collect()}
    rules = spark.createDataFrame([("r2", h["B"]), ("r3", "old"), ("r4", h["D"])], "id string, content_hash string")
    links = spark.createDataFrame([("p2", "r2"), ("p3", "r3"), ("p4", "r4")], "src string, dst string")
    done = spark.createDataFrame([(h["D"], True), (h["B"], False)], "content_hash string, stale boolean")
    assert [(a, c) for a, _, c in rows(T.candidates(p, links, rules, done))] == [("p1", "new"), ("p3", "changed"), ("p4", "stale")]


U = "unit_id bigint, kind string, name string, source string, node_id string"


def test_narration(spark):
    units = spark.createDataFrame([(1, "paragraph", "A", "PASSWORD = x1\nB", "n1"), (2, "paragraph", "A2", "PASSWORD = x2\nB", "n2"), (3, "config", "C", "other", "n3"), (4, "config", "D", None, "n4")], U)
    none = spark.createDataFrame([], "content_hash string, stale boolean")
    todo = M.to_narrate(units, none)
    got = {r["name"]: r for r in todo.collect()}
    assert set(got) == {"A", "C"} and got["A"]["n_units"] == 2 and "x1" not in got["A"]["redacted"]  # redacted alike, narrated once
    known = todo.where("name = 'A'").select(F.col("hash").alias("content_hash"), F.lit(False).alias("stale"))
    assert [r["name"] for r in M.to_narrate(units, known).collect()] == ["C"]
    assert M.to_narrate(units, known.withColumn("stale", F.lit(True))).count() == 2
    reply = json.loads({r["hash"]: r["reply"] for r in M.narrate(todo).collect()}[got["A"]["hash"]])
    assert reply["line_range"] == [1, 2] and reply["rule"].startswith("Business rule for A")
    asked = M.narrate(todo, lambda: lambda prompts: [p.split("\n")[1] for p in prompts])
    assert sorted(r["reply"] for r in asked.collect()) == ["Unit name: A", "Unit name: C"]
    gated = M.gated(units).join(units.select("unit_id", "node_id"), "unit_id")
    nodes, edges = M.rule_nodes(gated, M.narrate(todo), F.lit("cb"))
    assert edges.count() == 3 and nodes.count() == 3  # handed to every unit that shares the text


def test_replies_and_budget_sums(spark):
    r = spark.createDataFrame([('```json\n{"rule": "r", "confidence": 0.5}\n```',), ("no json",)], "reply string").select(M.parsed(F.col("reply")).alias("p")).collect()
    assert (r[0]["p"]["rule"], r[0]["p"]["confidence"]) == ("r", 0.5) and r[1]["p"]["rule"] == "no json" and r[1]["p"]["edge_cases"] == ["parse_failed"]
    df = spark.createDataFrame([(i, 10 + i) for i in range(50)], "k int, tokens int").repartition(5)
    got = {x["k"]: x["spent"] for x in M.spent_before(df, "tokens", ["k"]).collect()}
    assert got == {i: sum(10 + j for j in range(i)) for i in range(50)}


def test_spent_is_the_running_sum_over_many_sampled_ranges(spark):
    df = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), (F.col("id") % 5).alias("n_units"), (F.col("id") % 90 + 10).alias("tokens"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        M.spent_before(df, "tokens", ["hash"]).createOrReplaceTempView("got")
        df.createOrReplaceTempView("items")
        want = "SELECT hash, n_units, tokens, coalesce(sum(tokens) OVER (ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM items"
        n, same = spark.sql(f"SELECT count(*), count_if(g.spent = w.spent AND g.n_units = w.n_units) FROM ({want}) w LEFT JOIN got g USING (hash)").first()
        assert (n, same, spark.table("got").count()) == (200_000, 200_000, 200_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_reports(spark):
    nodes, edges = graph(spark)
    d = {r["name"]: r for r in R.dependencies(nodes, edges).collect()}
    assert (d["A"]["calls"], d["A"]["n_calls"], d["A"]["reads"], d["A"]["includes"], d["B"]["callers"]) == ("B,Program:c:GONE", 2, "T", "K", "A")
    assert sorted((r["finding"], r["name"]) for r in R.patterns(nodes, edges).collect()) == [("goto_heavy", "A.P"), ("standalone", "A"), ("unreachable", "A.Q")]
    assert rows(R.copybooks(nodes, edges)) == [("Copybook:c:K", "K", "c", 1, 1)]
    assert rows(R.workflow(nodes, edges)) == [("c", "J", 2, "S1=-,S2=A")]
    assert [r["name"] for r in R.migration_candidates(nodes).collect()] == ["B", "A"]
    assert rows(R.program_rollup(nodes)) == [("c", "A", 2, 6.0, 6.0, 0.75, 3.15)]
    log = spark.createDataFrame([("x", "Program", "h1", 1), ("x", "Program", "h2", 2), ("y", "Program", "h", 1)], "id string, type string, content_hash string, ts int")
    assert rows(R.change_history(log, "Program")) == [("x", 2, 2, 1, 2)]
    doc = R.document(R.copybooks(nodes, edges), "copybooks", F.concat(F.lit("Book "), "name"), "name", "n_fields").first()
    assert (doc["id"], doc["content"]) == ("book-k", "| K | 1 |")


def test_cache_log_is_latest_wins(spark):
    from orefield.sources import cache as C

    log = spark.createDataFrame(
        [("h1", "put", "a", False, 1, 1), ("h1", "verify", None, None, 2, 2), ("h1", "stale", None, None, 3, 3), ("h2", "put", "b", True, 1, 4), ("h2", "stale", None, None, 2, 5), ("h2", "put", "c", False, 9, 6), ("h3", "stale", None, None, 1, 7), (None, "put", "x", True, 1, 8)],
        "content_hash string, op string, payload string, human_verified boolean, ts int, seq int",
    )
    assert rows(C.narrations(log)) == [("h1", "a", 1, True, True), ("h2", "c", 9, False, False)] and C.narrations(log.limit(0)).count() == 0
    units = spark.createDataFrame([("h", 1)], "h string, n int")
    assert C.marks(units, F.col("h"), "stale", F.col("n"), F.col("n")).first()["op"] == "stale"
    with pytest.raises(ValueError):
        C.marks(units, F.col("h"), "drop", F.col("n"), F.col("n"))


def test_rules_tests_history_and_written_reports(spark, tmp_path):
    rules = spark.createDataFrame([("r1", "R1", '{"human_verified": true, "edge_cases": ["e"], "rule": "x"}', 2.0), ("r2", "R2", '{"human_verified": 1}', 5.0), ("r3", "R3", '{"human_verified": "no"}', 9.0), ("r4", "R4", None, 1.0)], "id string, name string, properties string, risk double")
    links = spark.createDataFrame([("p1", "r1"), ("p2", "r1"), ("gone", "r2")], "src string, dst string")
    nodes = spark.createDataFrame([("p1", "A"), ("p2", "B")], "id string, name string")
    got = R.suggested_tests(rules, links, nodes).collect()
    assert [(r["id"], r["paragraph"], r["rule"], r["scenarios"][0]) for r in got] == [("r2", "R2", "", "normal run of R2"), ("r1", "B", "x", "e")]
    assert R.suggested_tests(rules, links, nodes, 1).count() == 1 and tuple(R.rule_counts(rules).first()) == (4, 2, 2)
    log = spark.createDataFrame([("r1", "BusinessRule", 1), ("r1", "BusinessRule", 2), ("r2", "BusinessRule", 1), ("r3", "Program", 1)], "id string, type string, ts int")
    assert rows(R.rule_history(rules, log)) == [("r1", "R1", "changed", 2, 2), ("r2", "R2", "stable", 1, 1), ("r3", "R3", "unverified", 0, None), ("r4", "R4", "unverified", 0, None)]
    docs = [R.document(rules, "a", F.col("name"), "risk"), R.document(rules.limit(1), "b", F.col("name"), "risk")]
    assert rows(R.write_reports(docs, str(tmp_path / "out"))) == [("a", 4), ("b", 1)] and spark.read.parquet(str(tmp_path / "out/reports")).count() == 5
    some = spark.createDataFrame([("BusinessRule:c:ABX", "BusinessRule", "ABX"), ("BusinessRule:c:AB", "BusinessRule", "AB"), ("Program:c:AB", "Program", "AB"), ("T", "DB2Table", "a")], "id string, type string, name string")
    assert [r["name"] for r in R.resolve_rule(some, "BX").collect()] == ["ABX"] and [r["name"] for r in R.resolve_rule(some, "BusinessRule:c:ABX").collect()] == ["ABX"] and R.resolve_rule(some, "zz").count() == 0
    assert [r["id"] for r in R.sample(some, 3).collect()] == ["BusinessRule:c:AB", "BusinessRule:c:ABX", "Program:c:AB"]


def test_work_queue_leaves_new_ones_out(spark):
    p = spark.createDataFrame([("p1", "W" * 40), ("p2", "X" * 40), ("p3", "Y" * 40), ("p4", "Z" * 40)], "id string, source string")
    h = {r["id"]: r["h"] for r in p.select("id", content_hash(redact(F.col("source"))).alias("h")).collect()}
    rules = spark.createDataFrame([("r2", h["p2"]), ("r3", "old"), ("r4", h["p4"])], "id string, content_hash string")
    links = spark.createDataFrame([("p2", "r2"), ("p3", "r3"), ("p4", "r4")], "src string, dst string")
    done = spark.createDataFrame([(h["p4"], True), (h["p2"], False)], "content_hash string, stale boolean")
    risky = spark.createDataFrame([("p1", 9.0), ("p2", 9.0), ("p3", 5.0), ("p4", 8.0)], "id string, risk double")
    assert rows(T.work_queue(p, links, rules, done, risky, 100, 3.0)) == [("p3", 5.0, 10, "changed"), ("p4", 8.0, 10, "stale")]
    assert [r["node_id"] for r in T.work_queue(p, links, rules, done, risky, 15, 3.0).collect()] == ["p4"]


def test_totals(spark):
    units = spark.createDataFrame([(1, "k", "A", "PASSWORD = x1\nB", "n"), (2, "k", "A2", "PASSWORD = x2\nB", "n"), (3, "k", "C", "other", "n"), (4, "k", "D", None, "n")], U)
    made = M.gated(units)
    known = made.where("name = 'C'").select(F.col("hash").alias("content_hash"), F.lit(False).alias("stale"))
    assert tuple(M.totals(made, known, F.lit(7)).first()) == (1, 1, 7, 2, 1)
    with pytest.raises(ValueError):
        M.gated(units, patterns=())
