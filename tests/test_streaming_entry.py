import subprocess
import sys
from datetime import datetime as dt
from pathlib import Path

from orefield.operators.graph import counts_by_type
from orefield.sources.store import GraphStore
from orefield.streaming import ingest

ROOT = Path(__file__).resolve().parent.parent


def test_new_files_become_rows_once(spark, tmp_path):
    folder, store = tmp_path / "in", GraphStore(spark, str(tmp_path / "g"))
    row = lambda name, text: (name, text, "cb", None, 1, dt(2024, 1, 1))
    text = "       PROGRAM-ID. {0}.\n       PROCEDURE DIVISION.\n       A.\n           CALL '{1}'.\n"
    for name, calls in (("P1", "P2"), ("P2", "P3")):
        spark.createDataFrame([row(f"{name}.cbl", text.format(name, calls))], ingest.SOURCE_FILES).write.mode("append").parquet(str(folder))
        ingest.into_store(ingest.arriving_files(spark, str(folder)), store, str(tmp_path / "c")).awaitTermination()
    assert {r["type"]: r["n"] for r in counts_by_type(store.nodes()).collect()} == {"Program": 3, "Paragraph": 2}
    assert store.edges().count() == 2 and store.history().where("id = 'Program:cb:P2'").count() == 2
    assert store.node("Program:cb:P2").first()["parse_confidence"] == 1.0


def test_windows_of_arrivals(spark):
    df = spark.createDataFrame([(dt(2024, 1, 1, 0, m), k) for m, k in ((1, "a"), (4, "a"), (6, "b"))], "ts timestamp, event_type string")
    assert sorted((r["event_type"], r["n"]) for r in ingest.arrivals(df).collect()) == [("a", 2), ("b", 1)]


def test_registry_is_whole():
    import __spark_entry__ as entry

    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and {"p2_found", "p4_found", "p5_found"} <= set(queries)


def test_core_imports_without_llm():
    code = "import sys; sys.modules['orefield.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for path in (ROOT / "orefield").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "orefield.llm" not in path.read_text().replace("``orefield.llm``", ""), path
