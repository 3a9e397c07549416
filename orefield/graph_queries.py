"""Registered queries of the graph, extraction, triage, narration and report operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions.model import prop
from orefield.functions.text import REDACTIONS, content_hash, redact, redaction_counts
from orefield.operators import extract, graph, narrate, reports, triage
from orefield.plans.lineage import cut
from orefield.sources import cache, store
from orefield.sources.tables import micros, table
from orefield.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
LOW, BUDGET, THRESHOLD = 1.0, 50_000, 3.0


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return store.first_edges(table(spark, d, "edges"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    columns = ("id", "type", "name", "codebase_id", "content_hash", "parse_confidence", "properties")
    return table(spark, d, "nodes").select(*columns).unionByName(table(spark, d, "platform_nodes").select(*columns))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _nodes(spark, d), _edges(spark, d)


# ---------------------------------------------------------------- store and scans

def list_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes the parser doubted, with rounded confidence and the beginning of their hash."""
    n = _nodes(spark, d).where(F.col("parse_confidence") < LOW)
    return n.select("id", "name", "type", F.round("parse_confidence", 2).alias("confidence"), F.substring(F.coalesce("content_hash", F.lit("")), 1, 12).alias("hash"))


def latest_nodes(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_nodes(table(spark, d, "node_history")).select("id", "content_hash", "created_at", "updated_at")


def node_history_ops(spark: SparkSession, d: str) -> DataFrame:
    return store.history(table(spark, d, "node_history")).select("id", "seq", "op")


def edge_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("src", "dst", "type", "created_at")


def store_diff(spark: SparkSession, d: str) -> DataFrame:
    """What the nodes table has beyond, without, or unlike the last state of the history."""
    log = table(spark, d, "node_history")
    return store.diff(table(spark, d, "nodes").where(~F.col("type").isin("Field", "DB2Column")), store.latest_nodes(log))


def changed_ids(spark: SparkSession, d: str) -> DataFrame:
    return store.changed_ids(table(spark, d, "node_history"))


_PASSTHROUGH = """
WITH linked AS (SELECT e.type, n.codebase_id, count(*) AS n_edges, count(DISTINCT e.src) AS n_src FROM edges e JOIN nodes n ON n.id = e.dst GROUP BY e.type, n.codebase_id)
SELECT type, codebase_id, n_edges, n_src, rank() OVER (PARTITION BY type ORDER BY n_edges DESC, codebase_id) AS place FROM linked WHERE n_edges > 1"""


def sql_passthrough(spark: SparkSession, d: str) -> DataFrame:
    for name in ("nodes", "edges"):
        table(spark, d, name).createOrReplaceTempView(name)
    return store.read_only_sql(spark, _PASSTHROUGH)


# ---------------------------------------------------------------- graph

def node_counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    return graph.counts_by_type(_nodes(spark, d))


def edge_counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    return graph.counts_by_type(_edges(spark, d))


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(*_graph(spark, d))


def hub_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.hubs(edges, nodes)


def neighbors_out(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.neighbors(edges, nodes)


def predecessors_in(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.predecessors(edges, nodes)


def touching(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.touching(edges, nodes)


def what_runs(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.runners(edges, nodes)


def triggers_on(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.triggers_on(edges, nodes)


def _first_table(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("type") == "DB2Table").agg(F.min("id").alias("id"))


def impact_2hop(spark: SparkSession, d: str) -> DataFrame:
    """All that is within two steps of the first table, dangling ids included."""
    nodes, edges = _graph(spark, d)
    return graph.impact(edges, nodes, _first_table(nodes), 2).select("id", "hop", "type", "name")


def impact_3hop(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.impact(edges, nodes, _first_table(nodes), 3, dangling=False).select("id", "hop", "type", "name")


def _fiftieth(nodes: DataFrame) -> DataFrame:
    """Distinct ids whose hash is divisible by 50: starts of every type, whatever their degree."""
    return nodes.where(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % 50 == 0).select("id").distinct()


def _raw_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges as they were delivered, some of them again: enough where only (src, dst) counts."""
    return table(spark, d, "edges").where(F.col("type").isNotNull())


def impact_2hop_starts(spark: SparkSession, d: str) -> DataFrame:
    """All that is within two steps of each of a fiftieth of all nodes, dangling ids included."""
    nodes, edges = _nodes(spark, d), _raw_edges(spark, d)
    return graph.impact_of_many(edges, nodes, _fiftieth(nodes), 2)


def impact_3hop_starts(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _nodes(spark, d), _raw_edges(spark, d)
    return graph.impact_of_many(edges, nodes, _fiftieth(nodes), 3, dangling=False)


def cascade_depth_all(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.depth_from_all(edges, nodes, "CASCADES_TO", alone=True)


def trigger_chain_depth(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.depth_from_all(edges, nodes, "TRIGGERS_TRIGGER", alone=True)


# ---------------------------------------------------------------- hashes, duplicates, redaction

def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash of every unit, and whether the stored one is stale."""
    u = table(spark, d, "units").where(F.col("source").isNotNull())
    return u.select("unit_id", content_hash(F.col("source")).alias("hash"), F.coalesce(content_hash(F.col("source")) != F.col("content_hash"), F.lit(True)).alias("stale"))


def dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    return triage.duplicates(table(spark, d, "units"))


def unit_changes(spark: SparkSession, d: str) -> DataFrame:
    """Units redelivered under their name in a codebase against what was loaded first under it."""
    u = table(spark, d, "units").where(F.col("name").isNotNull() & F.col("content_hash").isNotNull()).select("unit_id", F.concat_ws(":", "kind", "codebase_id", "name").alias("node_id"), "content_hash")
    first = u.groupBy("node_id").agg(F.min_by("content_hash", "unit_id").alias("content_hash"), F.min("unit_id").alias("first_unit"))
    later = u.join(first.select("node_id", "first_unit"), "node_id").where(F.col("unit_id") > F.col("first_unit"))
    return triage.unit_changes(later, first.withColumnRenamed("node_id", "id")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def redact_units(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "units").where(F.col("source").isNotNull())
    return u.select("unit_id", F.sha2(redact(F.col("source")), 256).alias("redacted_hash"))


def redact_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", redact(F.col("text")).alias("redacted"))


def redaction_findings(spark: SparkSession, d: str) -> DataFrame:
    """Matches per kind over all units and documents."""
    texts = table(spark, d, "units").select(F.lit("units").alias("source"), F.col("source").alias("t")).unionByName(table(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("text").alias("t")))
    found = texts.where(F.col("t").isNotNull()).select("source", F.explode(redaction_counts(F.col("t"))).alias("c"))
    return found.groupBy("source", F.col("c.kind").alias("kind")).agg(F.sum("c.n").alias("n"), F.count(F.lit(1)).alias("n_texts"))


# ---------------------------------------------------------------- risk and budget

def risk_score(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where(F.col("type").isin("Program", "Paragraph")).select("id", F.round(triage.risk_score(), 4).alias("risk"))


def combined_risk(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return triage.scored(nodes, edges).where("risk > 0").select("id", "type", F.round("risk", 4).alias("risk"))


def top_risk(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return triage.top_risks(triage.scored(nodes, edges).where(F.col("type").isin("Paragraph", "Program", "DB2Table", "Trigger") & (F.col("risk") > 0)), 20)


def risk_bands(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return triage.risk_bands(triage.scored(nodes, edges))


def work_queue_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Programs by the risk summed over their paragraphs, chosen within a budget of tokens of source."""
    nodes = table(spark, d, "nodes")
    risky = reports.program_rollup(nodes).select(F.concat(F.lit("Program:"), "codebase_id", F.lit(":"), "program").alias("id"), "risk")
    programs = nodes.where(F.col("type") == "Program").select(F.col("id").alias("node_id"), prop("source_file").alias("source_file"))
    units = programs.join(table(spark, d, "source_files").select("source_file", F.col("text").alias("source")).where(F.col("text").isNotNull()), "source_file")
    return triage.within_budget(triage.work_items(units, risky), BUDGET, THRESHOLD)


# ---------------------------------------------------------------- narration

def _gated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Units redacted and hashed once, and the narrations that exist: of those loaded before mid 2025, the post-expanded ones marked stale."""
    made = cut(narrate.gated(table(spark, d, "units"), "loaded_at", "post_expansion"))
    old = made.where("loaded_at < timestamp'2025-07-01'")
    return made, old.groupBy(F.col("hash").alias("content_hash")).agg(F.bool_and(F.coalesce("post_expansion", F.lit(False))).alias("stale"))


def narration_plan(spark: SparkSession, d: str) -> DataFrame:
    """Distinct redacted texts that still need a narration."""
    return narrate.to_narrate(*_gated(spark, d)).select("hash", "kind", "name", "n_units")


def _narrated(spark: SparkSession, d: str) -> DataFrame:
    todo = narrate.to_narrate(*_gated(spark, d))
    return todo.select("hash", "kind", "n_units", narrate.reply_tokens(narrate.mock_reply(F.col("name"), F.col("redacted"))).alias("tokens"))


def mock_narration(spark: SparkSession, d: str) -> DataFrame:
    """Replies of the deterministic narrator, their size and what was spent before them."""
    return narrate.spent_before(_narrated(spark, d), "tokens", ["hash"]).select("hash", "n_units", "tokens", "spent")


def narration_cache(spark: SparkSession, d: str) -> DataFrame:
    """State of a cache into which every unit was put when loaded, configurations marked stale and expanded copybooks verified after it."""
    u = table(spark, d, "units").where(F.col("content_hash").isNotNull())
    hash_, ts, seq = F.col("content_hash"), F.col("loaded_at"), F.col("unit_id") * 2
    log = cache.puts(u, hash_, F.col("name"), F.coalesce("post_expansion", F.lit(False)), ts, seq)
    log = log.unionByName(cache.marks(u.where("kind = 'config'"), hash_, "stale", ts, seq + 1)).unionByName(cache.marks(u.where("kind = 'copybook' and post_expansion"), hash_, "verify", ts, seq + 1))
    return cache.narrations(log).select("content_hash", "payload", "created_at", "human_verified", "stale")


def narration_totals(spark: SparkSession, d: str) -> DataFrame:
    made, known = _gated(spark, d)
    return narrate.totals(made, known, narrate.reply_tokens(narrate.mock_reply(F.col("name"), F.col("redacted"))))


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    """(id, first_hash, last_hash, source, verified, first_unit, last_unit): paragraphs by place and name, as first and last delivered."""
    u = table(spark, d, "units").where((F.col("kind") == "paragraph") & F.col("source_file").isNotNull() & F.col("name").isNotNull() & F.col("codebase_id").isNotNull())
    made = narrate.gated(u, "codebase_id", "source_file", "source", "post_expansion").withColumn("id", F.concat_ws(":", F.lit("Paragraph"), "codebase_id", "source_file", "name"))
    return cut(made.groupBy("id").agg(
        F.min_by("hash", "unit_id").alias("first_hash"), F.max_by("hash", "unit_id").alias("last_hash"), F.max_by("source", "unit_id").alias("source"), F.max("name").alias("name"),
        F.max_by(F.coalesce("post_expansion", F.lit(False)), "unit_id").alias("verified"), F.count(F.lit(1)).alias("n_rows"),
    ))


def _risk_of_text() -> Column:
    return F.round(F.regexp_count("source", F.lit(r"\b(?:IF|EVALUATE|PERFORM)\b")) * 0.5, 4)


def triage_queue(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs whose text changed since it was first narrated, or whose narration is stale, by risk within the budget."""
    p = _delivered(spark, d)
    rule = F.concat(F.lit("BusinessRule:"), "id")
    rules = p.select(rule.alias("id"), F.col("first_hash").alias("content_hash"))
    risky = p.select("id", _risk_of_text().alias("risk"))
    return triage.work_queue(p.select("id", "source"), p.select(F.col("id").alias("src"), rule.alias("dst")), rules, _gated(spark, d)[1], risky, BUDGET, 1.0)


def _rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules of the paragraphs as last delivered, their implements edges, and the paragraphs as nodes."""
    p = _delivered(spark, d)
    rule = F.concat(F.lit("BusinessRule:"), "id")
    facts = F.to_json(F.struct(F.array(F.lit(narrate.MOCK_EDGE_CASE)).alias("edge_cases"), F.col("verified").alias("human_verified"), F.concat(F.lit("Rule of "), "name").alias("rule")))
    return p.select(rule.alias("id"), F.concat(F.lit("Rule for "), "name").alias("name"), facts.alias("properties"), _risk_of_text().alias("risk")), p.select(F.col("id").alias("src"), rule.alias("dst")), p.select("id", "name")


def suggested_tests(spark: SparkSession, d: str) -> DataFrame:
    """The verified rules of highest risk, with what to test."""
    return reports.suggested_tests(*_rules(spark, d)).withColumn("scenarios", F.array_join("scenarios", "; "))


def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.rule_counts(_rules(spark, d)[0])


def rule_history(spark: SparkSession, d: str) -> DataFrame:
    """Rules changed over time, stable or unverified, by the deliveries of their paragraphs."""
    u = table(spark, d, "units").where("kind = 'paragraph' and coalesce(source, '') <> ''")
    log = u.select(F.concat(F.lit("BusinessRule:"), F.concat_ws(":", F.lit("Paragraph"), "codebase_id", "source_file", "name")).alias("id"), F.lit("BusinessRule").alias("type"), F.col("loaded_at").alias("ts"))
    return reports.rule_history(_rules(spark, d)[0], log).select("id", "state", "n_rows", "last_ts")


def report_documents(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all reports in one form, as they are written partitioned by category."""
    nodes, edges = _graph(spark, d)
    rules = _rules(spark, d)
    parts = [
        reports.document(reports.copybooks(nodes, edges), "copybooks", F.col("id"), "name", "n_fields", "n_users"),
        reports.document(reports.migration_candidates(nodes), "migration", F.col("id"), "name", "risk"),
        reports.document(reports.suggested_tests(*rules), "tests", F.col("id"), "name", "risk", "paragraph"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def event_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Events per kind and window of five minutes, with a watermark; as on the stream."""
    e = table(spark, d, "events")
    counted = ingest.arrivals(e.withColumn("ts", F.timestamp_micros(micros(e, "ts"))))
    return counted.select(F.unix_micros("window_start").alias("window_start"), "event_type", "n")


def codebase_diff(spark: SparkSession, d: str) -> DataFrame:
    """store_diff within the largest codebase."""
    log = table(spark, d, "node_history")
    return store.codebase_diff(table(spark, d, "nodes").where(~F.col("type").isin("Field", "DB2Column")), store.latest_nodes(log), "ledger")


def find_node(spark: SparkSession, d: str) -> DataFrame:
    return graph.find(_nodes(spark, d), "ln", "Program").select("id", "name")


def build_sample(spark: SparkSession, d: str) -> DataFrame:
    """What a summary of the build shows first."""
    return reports.sample(_nodes(spark, d))


# ---------------------------------------------------------------- reports

def unreachable(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.without_incoming(nodes, edges, "Paragraph", ["PERFORMS"]).select("id")


def standalone(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.without_incoming(nodes, edges, "Program", ["CALLS"]).select("id")


def pattern_findings(spark: SparkSession, d: str) -> DataFrame:
    return reports.patterns(*_graph(spark, d)).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


def dependency_map(spark: SparkSession, d: str) -> DataFrame:
    return reports.dependencies(*_graph(spark, d))


def copybook_usage(spark: SparkSession, d: str) -> DataFrame:
    return reports.copybooks(*_graph(spark, d))


def workflow_steps(spark: SparkSession, d: str) -> DataFrame:
    return reports.workflow(*_graph(spark, d))


def change_history(spark: SparkSession, d: str) -> DataFrame:
    return reports.change_history(table(spark, d, "node_history"), "Paragraph")


def migration_candidates(spark: SparkSession, d: str) -> DataFrame:
    return reports.migration_candidates(_nodes(spark, d))


def program_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reports.program_rollup(_nodes(spark, d))


# ---------------------------------------------------------------- extraction

def _made(spark: SparkSession, d: str, kind: str) -> extract.Extract:
    return extract.EXTRACTORS[kind](table(spark, d, "source_files"))


def extract_counts(spark: SparkSession, d: str) -> DataFrame:
    return extract.counts(extract.extract(table(spark, d, "source_files")))


def extract_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of all extractors, real ones before placeholders."""
    return extract.merged_nodes(extract.extract(table(spark, d, "source_files")).nodes).select("id", "type", "content_hash", "parse_confidence")


def extract_edges(spark: SparkSession, d: str) -> DataFrame:
    return extract.merged_edges(extract.extract(table(spark, d, "source_files")).edges).select("src", "dst", "type")


def extract_calls(spark: SparkSession, d: str) -> DataFrame:
    """Programs called by literal name, per file."""
    p = extract.programs(table(spark, d, "source_files"))
    return p.select("source_file", F.explode(F.regexp_extract_all("code", F.lit(r"(?i)CALL\s+[\"']([A-Z0-9-]+)[\"']"), F.lit(1))).alias("c")).groupBy("source_file", F.upper("c").alias("target")).agg(F.count(F.lit(1)).alias("n"))


def extract_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = extract.paragraphs(extract.programs(table(spark, d, "source_files")))
    return p.select("source_file", "full_name", "cyclomatic", "statements", content_hash(F.col("source")).alias("hash"))


def extract_includes(spark: SparkSession, d: str) -> DataFrame:
    p = extract.programs(table(spark, d, "source_files"))
    return p.select("source_file", F.explode("copies").alias("c")).groupBy("source_file", F.col("c.copybook").alias("copybook")).agg(F.max(F.size("c.pairs")).cast("bigint").alias("n_pairs"))


def extract_sql_access(spark: SparkSession, d: str) -> DataFrame:
    return extract.table_access(extract.programs(table(spark, d, "source_files"))).select("source_file", "access", "table")


def extract_fields(spark: SparkSession, d: str) -> DataFrame:
    return extract.fields(extract.programs(table(spark, d, "source_files"))).groupBy("source_file").agg(F.count(F.lit(1)).alias("n_fields"), F.count_if("bad").alias("n_bad"))


def extract_copybooks(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, "copybook").nodes.groupBy("source_file", "type").agg(F.count(F.lit(1)).alias("n"), F.min("parse_confidence").alias("confidence"))


def extract_jcl_steps(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, "jcl").edges.where("type = 'EXECUTES'").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def extract_jcl_lineage(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, "jcl").edges.where("type <> 'EXECUTES'").groupBy("dst", "type").agg(F.count(F.lit(1)).alias("n"))


def extract_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables, columns, constraints and views per DDL file."""
    return _made(spark, d, "ddl").nodes.groupBy("source_file", "type").agg(F.count(F.lit(1)).alias("n"))


def extract_triggers(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, "triggers").edges.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("n"))


def extract_maps(spark: SparkSession, d: str) -> DataFrame:
    m = _made(spark, d, "bms").nodes
    return m.select("id", F.json_array_length(F.get_json_object("properties", "$.maps")).cast("bigint").alias("n_maps"), F.json_array_length(F.get_json_object("properties", "$.fields")).cast("bigint").alias("n_fields"))


def extract_unit_tokens(spark: SparkSession, d: str) -> DataFrame:
    return extract.unit_tokens(extract.extract(table(spark, d, "source_files")).units)


_NAMES = [
    list_nodes, latest_nodes, node_history_ops, edge_first_wins, store_diff, changed_ids, sql_passthrough, node_counts_by_type, edge_counts_by_type, graph_summary, hub_nodes, neighbors_out,
    predecessors_in, touching, what_runs, triggers_on, impact_2hop, impact_3hop, impact_2hop_starts, impact_3hop_starts, cascade_depth_all, trigger_chain_depth, content_hashes, dedup_groups, unit_changes, redact_units, redact_documents,
    redaction_findings, risk_score, combined_risk, top_risk, risk_bands, work_queue_greedy, narration_plan, mock_narration, narration_cache, narration_totals, triage_queue, suggested_tests, rule_counts, rule_history, report_documents, build_sample, event_arrivals, codebase_diff, find_node, unreachable, standalone, pattern_findings, dependency_map, copybook_usage,
    workflow_steps, change_history, migration_candidates, program_rollup, extract_counts, extract_nodes, extract_edges, extract_calls, extract_paragraphs, extract_includes, extract_sql_access, extract_fields,
    extract_copybooks, extract_jcl_steps, extract_jcl_lineage, extract_tables, extract_triggers, extract_maps, extract_unit_tokens,
]
QUERIES: dict[str, Query] = {q.__name__: q for q in _NAMES}

# ---------------------------------------------------------------- SQL

_N = "n AS (SELECT id, type, name, codebase_id, content_hash, parse_confidence, properties FROM nodes UNION ALL SELECT id, type, name, codebase_id, content_hash, parse_confidence, properties FROM platform_nodes)"
_E = "e AS (SELECT src, dst, type, min(created_at) AS created_at FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2, 3)"
_NE = f"WITH RECURSIVE {_N}, {_E}"
_JSON = "(try_cast({} AS json) ->> '{}')"
_NUMBER = "coalesce(try_cast(" + _JSON.format("properties", "{}") + " AS double), 0)"
_RISK = (
    f"least(20.0, greatest(0.0, {_NUMBER.format('cyclomatic_complexity')} * 0.5 + {_NUMBER.format('goto_density')} * 0.2)) * CASE WHEN coalesce(parse_confidence, 1.0) < 0.5 THEN 0.3 ELSE 1.0 END"
)
_LATEST = "SELECT id, arg_max(content_hash, seq) AS h, arg_max(CASE WHEN content_hash IS NULL THEN 1 ELSE 0 END, seq) AS no_hash, min(seq) AS first_seq, max(seq) AS last_seq FROM node_history WHERE id IS NOT NULL GROUP BY 1"
_HASH = r"sha256(regexp_replace(regexp_replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+(\n|$)', '\1', 'g'), '\n$', ''))"


def _redacted(text: str) -> str:
    for kind, pattern in REDACTIONS:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '[REDACTED]:{kind}', 'g')"
    return text


_TODO = f"""WITH g AS (SELECT unit_id, kind, name, loaded_at, post_expansion, {_redacted('source')} AS r FROM units WHERE coalesce(source, '') <> ''),
h AS (SELECT *, {_HASH.format('r')} AS hash FROM g),
known AS (SELECT hash FROM h WHERE loaded_at < TIMESTAMP '2025-07-01' GROUP BY 1 HAVING NOT bool_and(coalesce(post_expansion, false))),
first AS (SELECT hash, arg_min(struct_pack(kind := kind, name := name, r := r), unit_id) AS u, count(*) AS n_units FROM h ANTI JOIN known USING (hash) GROUP BY 1),
todo AS (SELECT hash, u.kind AS kind, u.name AS name, n_units, length('{{"rule":"Business rule for ' || coalesce(trim(to_json(u.name)::varchar, '"'), 'null') || ': performs standard data processing with conditional branching.","confidence":0.5,"line_range":[1,'
  || greatest(1, length(u.r) - length(replace(u.r, chr(10), '')) + 1) || '],"edge_cases":["Review edge case around date boundary crossing"]}}') // 4 + 1 AS tokens FROM first)"""


_DELIVERED = f"""{_TODO}, v AS (SELECT concat_ws(':', 'Paragraph', w.codebase_id, w.source_file, w.name) AS id, w.name, w.source, w.loaded_at, coalesce(w.post_expansion, false) AS expanded, h.hash, w.unit_id FROM h JOIN units w USING (unit_id)
  WHERE w.kind = 'paragraph' AND w.source_file IS NOT NULL AND w.name IS NOT NULL AND w.codebase_id IS NOT NULL),
d AS (SELECT id, max(name) AS name, arg_min(hash, unit_id) AS first_hash, arg_max(hash, unit_id) AS last_hash, arg_max(source, unit_id) AS source, arg_max(expanded, unit_id) AS verified, count(*) AS n_rows, max(loaded_at) AS last_ts FROM v GROUP BY 1),
p AS (SELECT *, round(len(regexp_extract_all(source, '\\b(?:IF|EVALUATE|PERFORM)\\b')) * 0.5::double, 4) AS risk FROM d)"""


def _depth(edge_type: str) -> str:
    return f"""{_NE}, s AS (SELECT DISTINCT e.src, e.dst FROM e JOIN n ON n.id = e.dst WHERE e.type = '{edge_type}'),
r AS (SELECT src AS start, src AS id, 0 AS hop FROM s UNION SELECT r.start, s.dst, r.hop + 1 FROM r JOIN s ON s.src = r.id WHERE r.hop < 60),
m AS (SELECT start, id, min(hop) AS hop FROM r GROUP BY 1, 2), d AS (SELECT start AS id, max(hop) AS depth FROM m GROUP BY 1)"""


_SCORED = f"""{_NE},
s1 AS (SELECT DISTINCT e.src, e.dst FROM e JOIN n ON n.id = e.dst WHERE e.type = 'CASCADES_TO'), s2 AS (SELECT DISTINCT e.src, e.dst FROM e JOIN n ON n.id = e.dst WHERE e.type = 'TRIGGERS_TRIGGER'),
r1 AS (SELECT src AS start, src AS id, 0 AS hop FROM s1 UNION SELECT r1.start, s1.dst, r1.hop + 1 FROM r1 JOIN s1 ON s1.src = r1.id WHERE r1.hop < 60),
r2 AS (SELECT src AS start, src AS id, 0 AS hop FROM s2 UNION SELECT r2.start, s2.dst, r2.hop + 1 FROM r2 JOIN s2 ON s2.src = r2.id WHERE r2.hop < 60),
x AS (SELECT start AS id, 'DB2Table' AS type, max(hop) * 0.5 AS extra FROM (SELECT start, id, min(hop) AS hop FROM r1 GROUP BY 1, 2) GROUP BY 1
  UNION ALL SELECT start, 'Trigger', max(hop) * 0.8 FROM (SELECT start, id, min(hop) AS hop FROM r2 GROUP BY 1, 2) GROUP BY 1),
scored AS (SELECT n.*, round({_RISK} + coalesce(x.extra, 0), 6) AS risk FROM n LEFT JOIN x ON x.id = n.id AND x.type = n.type)"""


def _names(label: str, key: str, other: str, kind: str) -> str:
    return f"{label} AS (SELECT e.{key} AS id, string_agg(DISTINCT coalesce(n.name, e.{other}), ',' ORDER BY coalesce(n.name, e.{other})) AS names, count(DISTINCT coalesce(n.name, e.{other})) AS k FROM e LEFT JOIN n ON n.id = e.{other} WHERE e.type = '{kind}' GROUP BY 1)"


def _impact(hops: int, dangling: bool) -> str:
    only = "" if dangling else "WHERE dst IN (SELECT id FROM n)"
    return f"""{_NE}, b AS (SELECT src, dst FROM (SELECT src, dst FROM e UNION SELECT dst, src FROM e) {only}),
r AS (SELECT min(id) AS id, 0 AS hop FROM n WHERE type = 'DB2Table' UNION SELECT b.dst, r.hop + 1 FROM r JOIN b ON b.src = r.id WHERE r.hop < {hops}),
m AS (SELECT id, min(hop) AS hop FROM r GROUP BY 1) SELECT m.id, m.hop, n.type, n.name FROM m LEFT JOIN n ON n.id = m.id WHERE m.hop > 0"""


def _impact_of_many(hops: int, dangling: bool) -> str:
    only = "" if dangling else "WHERE dst IN (SELECT id FROM n)"
    return f"""{_NE}, b AS (SELECT src, dst FROM (SELECT src, dst FROM e UNION SELECT dst, src FROM e) {only}),
r AS (SELECT DISTINCT id AS start, id, 0 AS hop FROM n WHERE ('0x' || substr(md5(id), 1, 8))::BIGINT % 50 = 0 UNION SELECT r.start, b.dst, r.hop + 1 FROM r JOIN b ON b.src = r.id WHERE r.hop < {hops}),
m AS (SELECT start, id, min(hop) AS hop FROM r GROUP BY 1, 2) SELECT m.start, m.id, m.hop, n.type, n.name FROM m LEFT JOIN n ON n.id = m.id WHERE m.hop > 0"""


_UNREACHABLE = "SELECT id FROM n WHERE type = 'Paragraph' AND NOT EXISTS (SELECT 1 FROM e WHERE e.type = 'PERFORMS' AND e.dst = n.id)"
_STANDALONE = "SELECT id FROM n WHERE type = 'Program' AND NOT EXISTS (SELECT 1 FROM e WHERE e.type = 'CALLS' AND e.dst = n.id)"

_LINES = "string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
_AREA = "CASE WHEN substr(x, 7, 1) IN ('*', '/') THEN '' WHEN length(x) >= 7 AND substr(x, 7, 1) NOT IN (' ', '-') THEN x[1:72] WHEN length(x) > 7 THEN x[8:72] ELSE x END"
_LITERALS = """'(?:[^'']|'''')*''|"(?:[^"]|"")*"'""".replace("'(?:", "'''(?:", 1)
_NAME = r"[A-Za-z_][\w$#]*(?:\.[A-Za-z_][\w$#]*)?"
_VERBS = "|".join([*extract.STATEMENTS, *extract.CLAUSES, "END-[A-Z]+"])
_BARE = f"regexp_replace({{}}, {_LITERALS}, '', 'g')"
_CODE = rf"f AS (SELECT source_file, regexp_replace(array_to_string(list_transform({_LINES}, lambda x: regexp_replace({_AREA}, '\s+$', '')), chr(10)), {_LITERALS}, '', 'g') AS bare FROM source_files WHERE regexp_matches(source_file, '(?i)\.(cbl|cob)$'))"


def _findings() -> str:
    text, parts = "t", []
    for kind, pattern in REDACTIONS:
        pattern = pattern.replace("'", "''")
        parts.append(f"SELECT source, '{kind}' AS kind, len(regexp_extract_all({text}, '{pattern}')) AS k FROM x")
        text = f"regexp_replace({text}, '{pattern}', '[REDACTED]:{kind}', 'g')"
    return "WITH x AS (SELECT 'units' AS source, source AS t FROM units WHERE source IS NOT NULL UNION ALL SELECT 'documents', text FROM documents WHERE text IS NOT NULL) SELECT source, kind, sum(k)::bigint AS n, count(*) AS n_texts FROM (" + " UNION ALL ".join(parts) + ") WHERE k > 0 GROUP BY 1, 2"


SQL: dict[str, str] = {
    "list_nodes": f"WITH {_N} SELECT id, name, type, round(parse_confidence, 2) AS confidence, substr(coalesce(content_hash, ''), 1, 12) AS hash FROM n WHERE parse_confidence < 1.0",
    "latest_nodes": f"WITH l AS ({_LATEST}) SELECT l.id, b.content_hash, a.ts AS created_at, b.ts AS updated_at FROM l JOIN node_history a ON a.id = l.id AND a.seq = (SELECT min(seq) FROM node_history x WHERE x.id = l.id AND x.ts IS NOT NULL) JOIN node_history b ON b.id = l.id AND b.seq = l.last_seq",
    "node_history_ops": "SELECT id, seq, CASE WHEN seq = min(seq) OVER (PARTITION BY id) THEN 'add' ELSE 'update' END AS op FROM node_history",
    "edge_first_wins": f"WITH {_E} SELECT src, dst, type, created_at FROM e",
    "store_diff": "WITH o AS (SELECT id, content_hash FROM node_history QUALIFY_ROW), w AS (SELECT id, content_hash FROM nodes WHERE type NOT IN ('Field', 'DB2Column')) SELECT coalesce(w.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' ELSE 'changed' END AS status FROM w FULL JOIN o ON o.id = w.id WHERE o.id IS NULL OR w.id IS NULL OR w.content_hash IS DISTINCT FROM o.content_hash".replace("SELECT id, content_hash FROM node_history QUALIFY_ROW", "SELECT id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM node_history) WHERE k = 1"),
    "changed_ids": "SELECT id, count(*) AS n_rows, max(ts) AS last_ts FROM node_history GROUP BY id HAVING count(*) > 1",
    "sql_passthrough": _PASSTHROUGH,
    "node_counts_by_type": f"WITH {_N} SELECT type, count(*) AS n FROM n GROUP BY 1",
    "edge_counts_by_type": f"WITH {_E} SELECT type, count(*) AS n FROM e GROUP BY 1",
    "graph_summary": f"WITH {_N}, {_E} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM n WHERE type = 'Paragraph') AS n_units, 'stable' AS health",
    "hub_nodes": f"WITH {_N}, {_E}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT n.id, n.type, n.name, g.degree FROM g JOIN n USING (id)",
    "neighbors_out": f"WITH {_N}, {_E} SELECT e.src, e.type, e.dst, n.type AS dst_type, n.name AS dst_name FROM e JOIN n ON n.id = e.dst",
    "predecessors_in": f"WITH {_N}, {_E} SELECT e.dst, e.type, e.src, n.type AS src_type, n.name AS src_name FROM e JOIN n ON n.id = e.src",
    "touching": f"WITH {_N}, {_E} SELECT e.src AS id, e.type, 'out' AS direction, e.dst AS other, n.type AS other_type, n.name AS other_name FROM e JOIN n ON n.id = e.dst UNION ALL SELECT e.dst, e.type, 'in', e.src, n.type, n.name FROM e JOIN n ON n.id = e.src WHERE e.src <> e.dst",
    "what_runs": f"WITH {_N}, {_E} SELECT e.dst, p.name AS program, e.type, e.src, r.type AS runner_type, r.name AS runner, CASE WHEN e.type = 'EXECUTES' THEN {_JSON.format('r.properties', 'parent_job')} END AS parent_job FROM e JOIN n p ON p.id = e.dst AND p.type = 'Program' JOIN n r ON r.id = e.src WHERE e.type IN ('EXECUTES', 'CALLS')",
    "triggers_on": f"WITH {_N}, {_E}, c AS (SELECT e.src, string_agg(DISTINCT n.name, ',' ORDER BY n.name) AS chain FROM e JOIN n ON n.id = e.dst WHERE e.type = 'TRIGGERS_TRIGGER' GROUP BY 1) SELECT e.dst AS table_id, e.src AS trigger_id, coalesce(c.chain, '') AS chain FROM e JOIN n ON n.id = e.src LEFT JOIN c ON c.src = e.src WHERE e.type = 'FIRES_ON'",
    "impact_2hop": _impact(2, True),
    "impact_3hop": _impact(3, False),
    "impact_2hop_starts": _impact_of_many(2, True),
    "impact_3hop_starts": _impact_of_many(3, False),
    "cascade_depth_all": f"{_depth('CASCADES_TO')} SELECT id, depth FROM d",
    "trigger_chain_depth": f"{_depth('TRIGGERS_TRIGGER')} SELECT id, depth FROM d",
    "content_hashes": f"WITH h AS (SELECT unit_id, content_hash, {_HASH.format('source')} AS hash FROM units WHERE source IS NOT NULL) SELECT unit_id, hash, coalesce(hash <> content_hash, true) AS stale FROM h",
    "dedup_groups": f"SELECT {_HASH.format('source')} AS hash, count(*) AS n_units, min(unit_id) AS first_unit FROM units WHERE source IS NOT NULL GROUP BY 1",
    "unit_changes": "WITH u AS (SELECT unit_id, kind || ':' || codebase_id || ':' || name AS k, content_hash FROM units WHERE name IS NOT NULL AND content_hash IS NOT NULL), f AS (SELECT k, arg_min(content_hash, unit_id) AS h, min(unit_id) AS first_unit FROM u GROUP BY 1) SELECT CASE WHEN u.content_hash = f.h THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS n FROM u JOIN f USING (k) WHERE u.unit_id > f.first_unit GROUP BY 1",
    "narration_plan": f"{_TODO} SELECT hash, kind, name, n_units FROM todo",
    "mock_narration": f"{_TODO} SELECT hash, n_units, tokens, coalesce(sum(tokens) OVER (ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS spent FROM todo",
    "narration_cache": """WITH l AS (SELECT content_hash, 'put' AS op, name, coalesce(post_expansion, false) AS v, loaded_at, unit_id * 2 AS seq FROM units WHERE content_hash IS NOT NULL
  UNION ALL SELECT content_hash, 'stale', NULL, NULL, NULL, unit_id * 2 + 1 FROM units WHERE content_hash IS NOT NULL AND kind = 'config' UNION ALL SELECT content_hash, 'verify', NULL, NULL, NULL, unit_id * 2 + 1 FROM units WHERE content_hash IS NOT NULL AND kind = 'copybook' AND post_expansion),
s AS (SELECT content_hash, arg_max(struct_pack(name := name, v := v, at := loaded_at), seq) FILTER (op = 'put') AS p, max(seq) FILTER (op = 'put') AS put_seq, max(seq) FILTER (op = 'verify') AS v_seq, max(seq) FILTER (op = 'stale') AS s_seq FROM l GROUP BY 1)
SELECT content_hash, p.name AS payload, p.at AS created_at, p.v OR coalesce(v_seq > put_seq, false) AS human_verified, coalesce(s_seq > put_seq, false) AS stale FROM s""",
    "narration_totals": f"""{_TODO} SELECT (SELECT count(*) FROM todo) AS created, (SELECT count(*) FROM h SEMI JOIN known USING (hash)) AS cache_hits, (SELECT coalesce(sum(tokens), 0)::bigint FROM todo) AS tokens,
  (SELECT count(*) FROM h WHERE contains(r, '[REDACTED]')) AS redacted, (SELECT coalesce(sum(n_units - 1), 0)::bigint FROM todo) AS repeats""",
    "triage_queue": f"""{_DELIVERED.replace('WITH g AS', 'WITH RECURSIVE g AS', 1)}, narr AS (SELECT hash, bool_and(coalesce(post_expansion, false)) AS stale FROM h WHERE loaded_at < TIMESTAMP '2025-07-01' GROUP BY 1),
i AS (SELECT p.id AS node_id, p.risk, greatest(1, length(p.source) // 4) AS tokens, CASE WHEN coalesce(narr.stale, false) THEN 'stale' ELSE 'changed' END AS reason FROM p LEFT JOIN narr ON narr.hash = p.first_hash WHERE p.first_hash <> p.last_hash OR coalesce(narr.stale, false)),
o AS (SELECT *, row_number() OVER (ORDER BY risk DESC, node_id) AS k FROM i WHERE risk >= 1.0 AND tokens <= {BUDGET}),
c AS (SELECT 0::bigint AS k, {BUDGET}::bigint AS remaining, false AS taken UNION ALL SELECT o.k, CASE WHEN o.tokens <= c.remaining THEN c.remaining - o.tokens ELSE c.remaining END, o.tokens <= c.remaining FROM c JOIN o ON o.k = c.k + 1)
SELECT o.node_id, o.risk, o.tokens, o.reason FROM o JOIN c ON c.k = o.k WHERE c.taken""",
    "suggested_tests": f"""{_DELIVERED} SELECT 'BusinessRule:' || id AS id, 'Rule for ' || name AS name, round(risk, 1) AS risk, name AS paragraph, substr('Rule of ' || name, 1, 120) AS rule,
  'Review edge case around date boundary crossing; normal run of ' || name || '; boundaries of dates and numbers; invalid input to ' || name || '; ' || name || ' within the program that calls it' AS scenarios FROM p WHERE verified ORDER BY p.risk DESC, 'BusinessRule:' || p.id LIMIT 15""",
    "rule_counts": f"{_DELIVERED} SELECT count(*) AS n_rules, count(*) FILTER (verified) AS n_verified, count(*) FILTER (NOT verified) AS n_unverified FROM p",
    "rule_history": f"{_DELIVERED} SELECT 'BusinessRule:' || id AS id, CASE WHEN n_rows > 1 THEN 'changed' WHEN verified THEN 'stable' ELSE 'unverified' END AS state, n_rows, last_ts FROM p",
    "build_sample": f"WITH {_N} SELECT id, type, name FROM n ORDER BY CASE WHEN type IN ('Program', 'Paragraph', 'BusinessRule') THEN 0 ELSE 1 END, type, lower(name), id LIMIT 10",
    "redact_units": f"SELECT unit_id, sha256({_redacted('source')}) AS redacted_hash FROM units WHERE source IS NOT NULL",
    "redact_documents": f"SELECT doc_id, {_redacted('text')} AS redacted FROM documents WHERE text IS NOT NULL",
    "risk_score": f"WITH {_N} SELECT id, round({_RISK}, 4) AS risk FROM n WHERE type IN ('Program', 'Paragraph')",
    "combined_risk": f"{_SCORED} SELECT id, type, round(risk, 4) AS risk FROM scored WHERE risk > 0",
    "top_risk": f"{_SCORED} SELECT id, type, name, round(risk, 2) AS risk FROM scored WHERE risk > 0 AND type IN ('Paragraph', 'Program', 'DB2Table', 'Trigger') ORDER BY scored.risk DESC, id LIMIT 20",
    "risk_bands": f"{_SCORED} SELECT count(*) FILTER (risk >= 5) AS high, count(*) FILTER (risk >= 2 AND risk < 5) AS medium, count(*) FILTER (risk < 2) AS low FROM scored WHERE risk > 0",
    "unreachable": f"WITH {_N}, {_E} {_UNREACHABLE}",
    "standalone": f"WITH {_N}, {_E} {_STANDALONE}",
    "pattern_findings": f"WITH {_N}, {_E} SELECT 'unreachable' AS finding, count(*) AS n FROM ({_UNREACHABLE}) HAVING count(*) > 0 UNION ALL SELECT 'standalone', count(*) FROM ({_STANDALONE}) HAVING count(*) > 0 UNION ALL SELECT 'goto_heavy', count(*) FROM n WHERE type = 'Paragraph' AND {_NUMBER.format('goto_density')} > 0.5 HAVING count(*) > 0",
    "dependency_map": f"WITH {_N}, {_E}, {_names('a', 'dst', 'src', 'CALLS')}, {_names('b', 'src', 'dst', 'CALLS')}, {_names('c', 'src', 'dst', 'READS')}, {_names('w', 'src', 'dst', 'WRITES')}, {_names('i', 'src', 'dst', 'INCLUDES')} SELECT n.id, n.name, " + ", ".join(f"coalesce({x}.names, '') AS {y}, coalesce({x}.k, 0) AS n_{y}" for x, y in (("a", "callers"), ("b", "calls"), ("c", "reads"), ("w", "writes"), ("i", "includes"))) + " FROM n LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id) LEFT JOIN w USING (id) LEFT JOIN i USING (id) WHERE n.type = 'Program'",
    "copybook_usage": f"WITH {_N}, {_E}, f AS (SELECT codebase_id, {_JSON.format('properties', 'parent_copybook')} AS name, count(*) AS k FROM n WHERE type = 'Field' GROUP BY 1, 2), u AS (SELECT dst AS id, count(DISTINCT src) AS k FROM e WHERE type = 'INCLUDES' GROUP BY 1) SELECT n.id, n.name, n.codebase_id, coalesce(f.k, 0) AS n_fields, coalesce(u.k, 0) AS n_users FROM n LEFT JOIN f ON f.codebase_id = n.codebase_id AND f.name = n.name LEFT JOIN u ON u.id = n.id WHERE n.type = 'Copybook'",
    "workflow_steps": f"WITH {_N}, {_E}, p AS (SELECT e.src AS id, string_agg(DISTINCT coalesce(n.name, e.dst), '+' ORDER BY coalesce(n.name, e.dst)) AS program FROM e LEFT JOIN n ON n.id = e.dst WHERE e.type = 'EXECUTES' GROUP BY 1), s AS (SELECT n.codebase_id, {_JSON.format('n.properties', 'parent_job')} AS job, n.name || '=' || coalesce(p.program, '-') AS line FROM n LEFT JOIN p USING (id) WHERE n.type = 'JCLStep') SELECT codebase_id, job, count(*) AS n_steps, string_agg(line, ',' ORDER BY line) AS steps FROM s WHERE job IS NOT NULL GROUP BY 1, 2",
    "change_history": "SELECT id, count(*) AS n_rows, count(DISTINCT content_hash) AS n_contents, min(ts) AS first_ts, max(ts) AS last_ts FROM node_history WHERE type = 'Paragraph' GROUP BY 1 HAVING count(*) > 1",
    "program_rollup": f"WITH {_N} SELECT codebase_id, {_JSON.format('properties', 'parent_program')} AS program, count(*) AS n_paragraphs, sum({_NUMBER.format('cyclomatic_complexity')}) AS complexity, max({_NUMBER.format('cyclomatic_complexity')}) AS worst, round(max({_NUMBER.format('goto_density')}), 4) AS goto_density, round(sum({_RISK}), 4) AS risk FROM n WHERE type = 'Paragraph' AND {_JSON.format('properties', 'parent_program')} IS NOT NULL GROUP BY 1, 2",
    "migration_candidates": f"WITH {_N} SELECT id, name, round({_RISK}, 4) AS risk, {_NUMBER.format('cyclomatic_complexity')} AS complexity, round({_NUMBER.format('goto_density')}, 4) AS goto_density, 0.0::double AS external_calls FROM n WHERE type = 'Program' ORDER BY 3 DESC, 1 LIMIT 10",
    "redaction_findings": _findings(),
    "work_queue_greedy": f"""WITH RECURSIVE p AS (SELECT 'Program:' || codebase_id || ':' || {_JSON.format('properties', 'parent_program')} AS id, round(sum({_RISK}), 4) AS risk FROM nodes WHERE type = 'Paragraph' GROUP BY 1),
i AS (SELECT n.id AS node_id, p.risk, greatest(1, length(f.text) // 4) AS tokens FROM nodes n JOIN p ON p.id = n.id JOIN source_files f ON f.source_file = {_JSON.format('n.properties', 'source_file')} WHERE n.type = 'Program' AND f.text IS NOT NULL),
o AS (SELECT *, row_number() OVER (ORDER BY risk DESC, node_id) AS k FROM i WHERE risk >= {THRESHOLD} AND tokens <= {BUDGET}),
g AS (SELECT 0::bigint AS k, {BUDGET}::bigint AS remaining, false AS taken UNION ALL SELECT o.k, CASE WHEN o.tokens <= g.remaining THEN g.remaining - o.tokens ELSE g.remaining END, o.tokens <= g.remaining FROM g JOIN o ON o.k = g.k + 1)
SELECT o.node_id, o.risk, o.tokens FROM o JOIN g ON g.k = o.k WHERE g.taken""",
    "extract_includes": rf"""WITH {_CODE}, c AS (SELECT source_file, unnest(regexp_extract_all(bare, '(?i)\bCOPY\s+([A-Z0-9-]+(?:\s+REPLACING\s+.+?)?)\s*\.', 1)) AS c FROM f)
SELECT source_file, upper(regexp_extract(c, '^([A-Za-z0-9-]+)', 1)) AS copybook, max(len(regexp_extract_all(c, '(?i)==[A-Z0-9-]+==\s+BY\s+==[A-Z0-9-]+=='))) AS n_pairs FROM c GROUP BY 1, 2""",
    "extract_sql_access": rf"""WITH {_CODE}, b AS (SELECT source_file, unnest(regexp_extract_all(bare, '(?is)\bEXEC\s+SQL\b(.*?)END-EXEC', 1)) AS b FROM f)
SELECT DISTINCT source_file, 'READS' AS access, upper(t) AS "table" FROM (SELECT source_file, unnest(regexp_extract_all(b, '(?i)\bFROM\s+([A-Z_][A-Z0-9_]+)', 1)) AS t FROM b)
UNION ALL SELECT DISTINCT source_file, 'WRITES', upper(t) FROM (SELECT source_file, unnest(list_concat(regexp_extract_all(b, '(?i)\bINTO\s+([A-Z_][A-Z0-9_]+)', 1), regexp_extract_all(b, '(?i)\bUPDATE\s+([A-Z_][A-Z0-9_]+)', 1))) AS t FROM b)""",
    "extract_jcl_steps": r"""WITH s AS (SELECT codebase_id, unnest(regexp_extract_all(text, '(?im)^//[A-Z0-9@#$.\-]*[ \t]+EXEC[ \t][^\n]*\bPGM\s*=\s*''?[^'',\s()]+')) AS x FROM source_files WHERE regexp_matches(source_file, '(?i)\.jcl$'))
SELECT 'JCLStep:' || codebase_id || ':' || CASE WHEN regexp_extract(x, '^//([A-Za-z0-9@#$.\-]*)', 1) = '' THEN 'ANONSTEP' ELSE upper(regexp_extract(x, '^//([A-Za-z0-9@#$.\-]*)', 1)) END AS src, 'Program:' || codebase_id || ':' || upper(regexp_extract(x, '(?i)\bPGM\s*=\s*''?([^'',\s()]+)', 1)) AS dst, count(*) AS n FROM s GROUP BY 1, 2""",
    "extract_fields": rf"""WITH g AS (SELECT source_file, array_to_string(list_transform({_LINES}, lambda x: regexp_replace({_AREA}, '\s+$', '')), chr(10)) AS code FROM source_files WHERE regexp_matches(source_file, '(?i)\.(cbl|cob)$')),
w AS (SELECT source_file, trim(unnest(string_split(regexp_extract(code, '(?is)WORKING-STORAGE\s+SECTION\.?[^\n]*\n(.*?)(?:\n\s*(?:LINKAGE|FILE|LOCAL-STORAGE)\s+SECTION|\n\s*PROCEDURE\s+DIVISION|\z)', 1), chr(10)))) AS l FROM g),
i AS (SELECT source_file, l, regexp_replace(regexp_extract(l, '(?i)\bPIC(?:TURE)?\s+(\S+)', 1), '\.$', '') AS pic FROM w WHERE regexp_matches(l, '^\d{{1,2}}\s') AND NOT regexp_matches(l, '^88\s'))
SELECT source_file, count(*) AS n_fields, count(*) FILTER (NOT regexp_matches(l, '^\d{{1,2}}\s+[A-Z0-9-]+\b.*\.\s*$') OR regexp_matches(pic, '[^A-Z0-9()$/.,+\-*V]')) AS n_bad FROM i GROUP BY 1""",
    "extract_calls": r"""WITH l AS (SELECT source_file, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS x FROM source_files WHERE regexp_matches(source_file, '(?i)\.(cbl|cob)$')),
c AS (SELECT source_file, unnest(regexp_extract_all(CASE WHEN substr(x, 7, 1) IN ('*', '/') THEN '' WHEN length(x) >= 7 AND substr(x, 7, 1) NOT IN (' ', '-') THEN x[1:72] WHEN length(x) > 7 THEN x[8:72] ELSE x END, '(?i)CALL\s+["'']([A-Z0-9-]+)["'']', 1)) AS c FROM l)
SELECT source_file, upper(c) AS target, count(*) AS n FROM c GROUP BY 1, 2""",
    "extract_triggers": r"""WITH s AS (SELECT codebase_id, unnest(regexp_extract_all(regexp_replace(text, '--[^\n]*', '', 'g'), '(?is)CREATE\s+TRIGGER\s+[A-Za-z_][\w$#.]*.*?\bEND\s*;')) AS x FROM source_files WHERE NOT regexp_matches(source_file, '(?i)\.(cbl|cob|cpy|copy|jcl|bms|map)$')),
t AS (SELECT codebase_id, upper(regexp_extract(x, '(?i)TRIGGER\s+([A-Za-z_][\w$#.]*)', 1)) AS name, upper(regexp_extract(regexp_replace(x, '(?is)\bBEGIN\b.*$', ''), '(?i)\bON\s+([A-Za-z_][\w$#.]*)', 1)) AS tab, unnest(list_distinct(regexp_extract_all(regexp_extract(x, '(?is)\bBEGIN\b(.*)$', 1), '(?i)\b((?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+[A-Za-z_][\w$#.]*)', 1))) AS dml FROM s)
SELECT 'Trigger:' || codebase_id || ':' || name AS src, 'DB2Table:' || codebase_id || ':' || tab AS dst, 'FIRES_ON' AS type, count(*) AS n FROM (SELECT DISTINCT codebase_id, name, tab FROM t) WHERE tab <> '' GROUP BY 1, 2
UNION ALL SELECT 'Trigger:' || codebase_id || ':' || name, 'Trigger:' || codebase_id || ':ON:' || upper(regexp_extract(dml, '(\S+)$', 1)) || ':' || upper(regexp_extract(dml, '^(\w+)', 1)), 'TRIGGERS_TRIGGER', count(*) FROM t WHERE upper(regexp_extract(dml, '(\S+)$', 1)) <> tab GROUP BY 1, 2""",
    "event_arrivals": "SELECT epoch_us(ts) // 300000000 * 300000000 AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "codebase_diff": "WITH o AS (SELECT id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM node_history) WHERE k = 1 AND codebase_id = 'ledger'), w AS (SELECT id, content_hash FROM nodes WHERE type NOT IN ('Field', 'DB2Column') AND codebase_id = 'ledger') SELECT coalesce(w.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' ELSE 'changed' END AS status FROM w FULL JOIN o ON o.id = w.id WHERE o.id IS NULL OR w.id IS NULL OR w.content_hash IS DISTINCT FROM o.content_hash",
    "find_node": f"WITH {_N} SELECT id, name FROM (SELECT *, CASE WHEN lower(name) = 'ln' OR id = 'ln' THEN 1 WHEN contains(lower(name), 'ln') OR contains(lower(id), 'ln') THEN 2 END AS tier FROM n WHERE type = 'Program') WHERE tier IS NOT NULL ORDER BY tier, id LIMIT 1",
    "extract_copybooks": rf"""WITH c AS (SELECT source_file, array_to_string(list_filter(list_transform({_LINES}, lambda x: regexp_replace({_AREA}, '\s+$', '')), lambda x: trim(x) <> ''), chr(10)) AS code FROM source_files WHERE regexp_matches(source_file, '(?i)\.(cpy|copy)$')),
e AS (SELECT source_file, unnest(list_filter(list_transform(regexp_split_to_array(code, '\.[ \t]*(?:\n|$)'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: regexp_matches(x, '^\d{{1,2}}(?:\s|$)') AND NOT regexp_matches(x, '^88\s'))) AS e FROM c),
i AS (SELECT source_file, upper(regexp_extract(e, '^\d{{1,2}} ([A-Za-z0-9-]+)', 1)) AS name, upper(regexp_extract(e, '(?i) PIC(?:TURE)?(?: IS)? (\S+)', 1)) AS pic FROM e),
b AS (SELECT source_file, (name = '' OR name IN ('PIC', 'PICTURE') OR regexp_matches(pic, '[^A-Z0-9()$/.,+\-*]')) AS bad FROM i)
SELECT source_file, 'Field' AS type, count(*) AS n, min(CASE WHEN bad THEN 0.5::double ELSE 1.0::double END) AS confidence FROM b GROUP BY 1
UNION ALL SELECT c.source_file, 'Copybook', 1, CASE WHEN coalesce(bool_or(bad), false) THEN 0.5::double ELSE 1.0::double END FROM c LEFT JOIN b ON b.source_file = c.source_file GROUP BY 1""",
    "extract_jcl_lineage": rf"""WITH l AS (SELECT source_file, codebase_id, unnest({_LINES}) AS x, generate_subscripts({_LINES}, 1) AS k FROM source_files WHERE regexp_matches(source_file, '(?i)\.jcl$')),
m AS (SELECT *, regexp_matches(x, '^//[ \t]+\S') AND coalesce(regexp_matches(lag(x) OVER w, '^//.*,[ \t]*$'), false) AS goes_on FROM l WHERE NOT starts_with(x, '//*') WINDOW w AS (PARTITION BY source_file ORDER BY k)),
s AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY source_file ORDER BY k) AS stmt FROM m),
t AS (SELECT source_file, codebase_id, stmt, string_agg(CASE WHEN goes_on THEN regexp_replace(x, '^//[ \t]+', '') ELSE x END, '' ORDER BY k) AS x FROM s GROUP BY ALL),
f AS (SELECT source_file, min(stmt) AS first FROM t WHERE regexp_matches(x, '(?i)^//[A-Z0-9@#$.\-]*[ \t]+EXEC[ \t]') GROUP BY 1),
d AS (SELECT codebase_id, upper(regexp_extract(x, '(?i)\bDSN(?:AME)?\s*=\s*''?([^'',\s()]+)', 1)) AS dsn, upper(regexp_extract(x, '(?i)\bDISP\s*=\s*\(?\s*([A-Z]+)', 1)) AS st, upper(regexp_extract(x, '(?i)\bDISP\s*=\s*\(\s*[A-Z]+\s*,\s*([A-Z]+)', 1)) AS normal
  FROM t JOIN f USING (source_file) WHERE stmt > first AND regexp_matches(x, '(?i)^//\S*[ \t]+DD[ \t]+')),
a AS (SELECT codebase_id, dsn, unnest(CASE WHEN st IN ('SHR', 'OLD') THEN ['READS'] WHEN st = 'MOD' AND normal = 'DELETE' THEN ['READS', 'WRITES'] WHEN st IN ('NEW', 'MOD') THEN ['WRITES'] ELSE [] END) AS type FROM d WHERE dsn <> '')
SELECT 'Dataset:' || codebase_id || ':' || dsn AS dst, type, count(*) AS n FROM a GROUP BY 1, 2""",
    "extract_tables": rf"""WITH c AS (SELECT source_file, regexp_replace(array_to_string({_LINES}, chr(10)), '--[^\n]*', '', 'g') AS code FROM source_files WHERE NOT regexp_matches(source_file, '(?i)\.(cbl|cob|cpy|copy|jcl|bms|map)$')),
t AS (SELECT source_file, unnest(regexp_extract_all(code, '(?is)CREATE\s+TABLE\s+{_NAME}\s*\(.*?\)[^;)]*;')) AS stmt FROM c),
e AS (SELECT source_file, trim(unnest(string_split(regexp_replace(regexp_replace(regexp_extract(stmt, '(?s)\((.*)\)[^;)]*;$', 1), '\([^()]*\)', '', 'g'), '\([^()]*\)', '', 'g'), ',')), ' ' || chr(10) || chr(9)) AS e FROM t),
k AS (SELECT source_file, regexp_matches(e, '(?i)^(CONSTRAINT|PRIMARY|FOREIGN|CHECK|UNIQUE)\b') AS con, regexp_matches(e, '(?i)\bPRIMARY\s+KEY\b') AS pk, regexp_matches(e, '^[A-Za-z_]') AS named FROM e WHERE e <> ''),
r AS (SELECT source_file, 'DB2Table' AS type FROM t UNION ALL SELECT source_file, 'DB2Column' FROM k WHERE NOT con AND named UNION ALL SELECT source_file, 'Constraint' FROM k WHERE con OR pk
  UNION ALL SELECT source_file, 'Constraint' FROM (SELECT source_file, unnest(regexp_extract_all(code, '(?i)CREATE\s+(?:UNIQUE\s+)?INDEX\s+{_NAME}\s+ON\s+{_NAME}\s*\([^)]*\)\s*;')) FROM c)
  UNION ALL SELECT source_file, 'View' FROM (SELECT source_file, unnest(regexp_extract_all(code, '(?is)CREATE\s+VIEW\s+{_NAME}\s.*?;')) FROM c))
SELECT source_file, type, count(*) AS n FROM r GROUP BY 1, 2""",
    "extract_paragraphs": rf"""WITH c AS (SELECT source_file, array_to_string(list_transform({_LINES}, lambda x: regexp_replace({_AREA}, '\s+$', '')), chr(10)) AS code FROM source_files WHERE regexp_matches(source_file, '(?i)\.(cbl|cob)$')),
q AS (SELECT source_file, CASE WHEN regexp_extract(code, '(?i)PROGRAM-ID\.\s*([A-Z0-9-]+)', 1) <> '' THEN upper(regexp_extract(code, '(?i)PROGRAM-ID\.\s*([A-Z0-9-]+)', 1)) ELSE upper(regexp_extract(source_file, '([^/]*?)(?:\.[^./]*)?$', 1)) END AS program, string_split(regexp_extract(code, '(?is)\bPROCEDURE\s+DIVISION[^\n]*\n(.*)', 1), chr(10)) AS lines,
  list_transform(regexp_extract_all({_BARE.format('code')}, '(?i)==[A-Z0-9-]+==\s+BY\s+==[A-Z0-9-]+=='), lambda p: string_split(p, '==')) AS pairs FROM c),
l AS (SELECT source_file, program, unnest(lines) AS x, generate_subscripts(lines, 1) AS k FROM q),
h AS (SELECT *, regexp_matches(x, '^[ \t]{{0,3}}[A-Z0-9][A-Z0-9-]*[ \t]*\.[ \t]*$') AND NOT regexp_matches(x, '^[ \t]*(?:{_VERBS})[ \t]*\.') AS head FROM l),
g AS (SELECT *, sum(head::int) OVER (PARTITION BY source_file ORDER BY k) AS nth, sum(head::int) OVER (PARTITION BY source_file) AS heads FROM h),
p AS (SELECT source_file, program, nth, heads, string_agg(trim(x), chr(10) ORDER BY k) FILTER (NOT head AND trim(x) <> '') AS body, max(CASE WHEN head THEN upper(regexp_extract(trim(x), '^[A-Za-z0-9-]+')) END) AS name FROM g GROUP BY ALL),
v AS (SELECT source_file, program, CASE WHEN heads = 0 THEN 'MAIN' ELSE name END AS name, coalesce(body, '') AS body FROM p WHERE nth > 0 OR (heads = 0 AND regexp_matches(body, '(?i)\b(PERFORM|CALL)\b'))),
b AS (SELECT v.*, {_BARE.format('v.body')} AS plain, list_reduce(list_prepend([name || '.' || chr(10) || v.body], list_transform(q.pairs, lambda p: [p[2], p[4]])), lambda a, p: [replace(a[1], '==' || upper(p[1]) || '==', upper(p[2]))])[1] AS source FROM v JOIN q USING (source_file))
SELECT source_file, program || '.' || name AS full_name, 1 + len(regexp_extract_all(plain, '(?i)\bIF\b')) + len(regexp_extract_all(plain, '(?i)\bEVALUATE\b')) + len(list_filter(regexp_extract_all(plain, '(?i)\bPERFORM\s+([A-Z0-9-]+\s+(?:THRU|THROUGH)\s+[A-Z0-9-]+)', 1), lambda x: NOT regexp_matches(x, '(?i)^(UNTIL|VARYING|WITH|TEST)\b'))) AS cyclomatic,
  len(regexp_extract_all(body, '(?m)\.\s*$')) AS statements, {_HASH.format('source')} AS hash FROM b""",
    "extract_maps": r"""SELECT 'CICSMap:' || codebase_id || ':' || upper(regexp_extract(text, '(?im)^([A-Z][\w$#]*)\s+DFHMSD\b', 1)) AS id, len(regexp_extract_all(text, '(?im)^[A-Z][\w$#]*\s+DFHMDI\b')) AS n_maps, len(regexp_extract_all(text, '(?im)^(?:[A-Z][\w$#]*)?[ \t]+DFHMDF\b')) AS n_fields
FROM source_files WHERE regexp_matches(source_file, '(?i)\.(bms|map)$') AND regexp_matches(text, '(?im)^[A-Z][\w$#]*\s+DFHMSD\b')""",
}
