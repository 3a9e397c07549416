from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from orefield.sources import store as S


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, type string, name string, codebase_id string, content_hash string, parse_confidence double, properties string")


def test_round_trip_history_and_sql(spark, tmp_path):
    store = S.GraphStore(spark, str(tmp_path / "g"))
    store.add_nodes(nodes(spark, [("P:a", "Program", "A", "cb", "h1", 1.0, "{}"), ("P:b", "Program", "B", "cb", "h2", 1.0, None)]), dt(2024, 1, 1))
    store.add_nodes(nodes(spark, [("P:a", "Program", "A", "cb", "h3", 0.5, "{}")]), dt(2024, 2, 1))
    store.add_edges(spark.createDataFrame([("P:a", "P:b", "CALLS", "1")], "src string, dst string, type string, properties string"), dt(2024, 1, 1))
    store.add_edges(spark.createDataFrame([("P:a", "P:b", "CALLS", "2"), ("P:a", None, "CALLS", "3")], "src string, dst string, type string, properties string"), dt(2024, 2, 1))
    a = store.node("P:a").first()
    assert (a["content_hash"], a["parse_confidence"], a["created_at"], a["updated_at"]) == ("h3", 0.5, dt(2024, 1, 1), dt(2024, 2, 1))
    assert [(r["id"], r["op"]) for r in store.history().orderBy("seq").collect()] == [("P:a", "add"), ("P:b", "add"), ("P:a", "update")]
    assert [r["properties"] for r in store.edges().collect()] == ["1"]
    assert store.sql("SELECT count(*) FROM nodes").first()[0] == 2
    with pytest.raises(ValueError):
        store.sql("DROP TABLE nodes")
    assert store.compact(str(tmp_path / "h")).nodes_log().count() == 2
    assert [r["id"] for r in S.changed_ids(store.nodes_log()).collect()] == ["P:a"]


def test_diff(spark):
    old, new = nodes(spark, [("a", "", "", "x", "1", 1.0, ""), ("b", "", "", "x", None, 1.0, ""), ("c", "", "", "y", "1", 1.0, "")]), nodes(spark, [("a", "", "", "x", "2", 1.0, ""), ("b", "", "", "x", None, 1.0, ""), ("d", "", "", "y", "1", 1.0, "")])
    assert sorted(map(tuple, S.diff(new, old).collect())) == [("a", "changed"), ("c", "removed"), ("d", "added")]
    assert sorted(map(tuple, S.codebase_diff(new, old, "x").collect())) == [("a", "changed")]
    assert S.last_of(old.withColumn("seq", F.monotonically_increasing_id()), "codebase_id", "seq").count() == 2


def test_read_tree_keeps_broken_bytes(spark, tmp_path):
    from orefield.sources.files import of_kind, read_tree

    (tmp_path / "a").mkdir()
    (tmp_path / "a/X.CBL").write_bytes(b"       PROGRAM-ID. X.\xff")
    (tmp_path / "b.ddl").write_text("create table t (a int);")
    files = read_tree(spark, str(tmp_path), "cb")
    assert files.count() == 2 and of_kind(files, "cobol").first()["text"].endswith("�") and of_kind(files, "ddl").count() == 1


def test_a_replayed_batch_is_stored_once_and_a_half_written_one_is_replaced(spark, tmp_path):
    store = S.GraphStore(spark, str(tmp_path / "g"))
    first = nodes(spark, [("P:a", "Program", "A", "cb", "h1", 1.0, None)])
    store.add_nodes(first, dt(2024, 1, 1), token="s.0")
    store.add_nodes(first, dt(2024, 1, 1), token="s.0")
    assert store.nodes_log().count() == 1
    store.add_nodes(nodes(spark, [("P:a", "Program", "A", "cb", "h2", 1.0, None)]), dt(2024, 1, 1), token="s.1")
    store.add_nodes(first, dt(2024, 1, 1), token="s.0")
    assert store.node("P:a").first()["content_hash"] == "h2" and [r["op"] for r in store.history().orderBy("seq").collect()] == ["add", "update"]
    (tmp_path / "g/nodes_log/batch=1-s.1/_SUCCESS").unlink()
    store.add_nodes(nodes(spark, [("P:a", "Program", "A", "cb", "h3", 1.0, None)]), dt(2024, 1, 1), token="s.1")
    assert store.node("P:a").first()["content_hash"] == "h3" and store.nodes_log().count() == 2


def test_read_tree_lists_what_is_too_large_and_unifies_line_ends(spark, tmp_path):
    from orefield.sources.files import read_tree

    (tmp_path / "a.cbl").write_bytes(b"A\r\nB\rC\n")
    (tmp_path / "b.cbl").write_bytes(b"x" * 50)
    assert {r["source_file"][-5:]: r["text"] for r in read_tree(spark, str(tmp_path), max_bytes=20).collect()} == {"a.cbl": "A\nB\nC\n", "b.cbl": None}
