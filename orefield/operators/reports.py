"""Reports over the graph as DataFrames; ``document`` renders any of them as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions.model import prop, prop_count, prop_number
from orefield.functions.text import slug
from orefield.operators.graph import without_incoming
from orefield.operators.triage import risk_score


def migration_candidates(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The k programs of highest risk with what makes them so."""
    p = nodes.where(F.col("type") == "Program")
    return (
        p.select("id", "name", F.round(risk_score(), 4).alias("risk"), prop_number("cyclomatic_complexity").alias("complexity"), F.round(prop_number("goto_density"), 4).alias("goto_density"), prop_count("external_calls").alias("external_calls"))
        .orderBy(F.desc("risk"), "id").limit(k)
    )


def program_rollup(nodes: DataFrame) -> DataFrame:
    """Risk of programs from their paragraphs: paragraphs, complexity summed and highest, goto density at most."""
    p = nodes.where(F.col("type") == "Paragraph").select("codebase_id", prop("parent_program").alias("program"), prop_number("cyclomatic_complexity").alias("c"), prop_number("goto_density").alias("g"), risk_score().alias("r"))
    return p.where(F.col("program").isNotNull()).groupBy("codebase_id", "program").agg(
        F.count(F.lit(1)).alias("n_paragraphs"), F.sum("c").alias("complexity"), F.max("c").alias("worst"), F.round(F.max("g"), 4).alias("goto_density"), F.round(F.sum("r"), 4).alias("risk"),
    )


def patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(finding, id, name, program): paragraphs nobody performs, paragraphs full of jumps, programs nobody calls."""
    program = nodes.where(F.col("type") == "Paragraph").select("id", prop("parent_program").alias("program"))
    unreachable = without_incoming(nodes, edges, "Paragraph", ["PERFORMS"]).join(program, "id").select(F.lit("unreachable").alias("finding"), "id", "name", "program")
    jumpy = nodes.where((F.col("type") == "Paragraph") & (prop_number("goto_density") > 0.5)).select(F.lit("goto_heavy").alias("finding"), "id", "name", prop("parent_program").alias("program"))
    alone = without_incoming(nodes, edges, "Program", ["CALLS"]).select(F.lit("standalone").alias("finding"), "id", "name", F.col("name").alias("program"))
    return unreachable.unionByName(jumpy).unionByName(alone)


def _names(edges: DataFrame, nodes: DataFrame, key: str, other: str, edge_type: str) -> DataFrame:
    """(id, names): per ``key`` end of edges of a type the sorted names of the other ends, ids where no node is known."""
    known = nodes.select(F.col("id").alias("other"), "name")
    return (
        edges.where(F.col("type") == edge_type).select(F.col(key).alias("id"), F.col(other).alias("other")).distinct()
        .join(known, "other", "left").groupBy("id").agg(F.array_sort(F.collect_set(F.coalesce("name", "other"))).alias("names"))
    )


def dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per program: who calls it, whom it calls, which tables and copybooks it uses (numbers and sorted names)."""
    out = nodes.where(F.col("type") == "Program").select("id", "name")
    for label, key, other, kind in (("callers", "dst", "src", "CALLS"), ("calls", "src", "dst", "CALLS"), ("reads", "src", "dst", "READS"), ("writes", "src", "dst", "WRITES"), ("includes", "src", "dst", "INCLUDES")):
        out = out.join(_names(edges, nodes, key, other, kind).withColumnRenamed("names", label), "id", "left")
        out = out.withColumn(f"n_{label}", F.coalesce(F.size(label), F.lit(0)).cast("bigint")).withColumn(label, F.coalesce(F.array_join(label, ","), F.lit("")))
    return out


def copybooks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per copybook: fields (by the name in their properties) and programs that include it."""
    fields = nodes.where(F.col("type") == "Field").select("codebase_id", prop("parent_copybook").alias("name")).where(F.col("name").isNotNull()).groupBy("codebase_id", "name").agg(F.count(F.lit(1)).alias("n_fields"))
    users = edges.where(F.col("type") == "INCLUDES").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n_users"))
    books = nodes.where(F.col("type") == "Copybook").select("id", "name", "codebase_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return books.join(fields, ["codebase_id", "name"], "left").join(users, "id", "left").select("id", "name", "codebase_id", zero("n_fields"), zero("n_users"))


def workflow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per job: its steps in order of name with the programs they execute."""
    steps = nodes.where(F.col("type") == "JCLStep").select(F.col("id").alias("step_id"), F.col("name").alias("step"), "codebase_id", prop("parent_job").alias("job"))
    programs = _names(edges, nodes, "src", "dst", "EXECUTES").select(F.col("id").alias("step_id"), F.array_join("names", "+").alias("program"))
    line = F.concat("step", F.lit("="), F.coalesce("program", F.lit("-")))
    return (
        steps.where(F.col("job").isNotNull()).join(programs, "step_id", "left").groupBy("codebase_id", "job")
        .agg(F.count(F.lit(1)).alias("n_steps"), F.array_join(F.array_sort(F.collect_list(line)), ",").alias("steps"))
    )


def change_history(log: DataFrame, node_type: str) -> DataFrame:
    """Ids of a type that changed: rows, different contents, first and last time."""
    return (
        log.where(F.col("type") == node_type).groupBy("id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("content_hash").alias("n_contents"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .where(F.col("n_rows") > 1)
    )


def document(rows: DataFrame, category: str, title: Column, *columns: str) -> DataFrame:
    """(category, id, title, content): one line of a Markdown table per row, for writing partitioned by category."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return rows.select(F.lit(category).alias("category"), slug(title).alias("id"), title.alias("title"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("content"))


def verified(of: str = "properties") -> Column:
    """Is a rule marked as verified by a reader?  Anything but a plain yes is none."""
    return F.coalesce(F.lower(prop("human_verified", of)).isin("true", "1", "yes"), F.lit(False))


def rule_counts(rules: DataFrame) -> DataFrame:
    """One row: rules, verified and unverified ones."""
    return rules.agg(F.count(F.lit(1)).alias("n_rules"), F.count_if(verified()).alias("n_verified"), F.count_if(~verified()).alias("n_unverified"))


def suggested_tests(rules: DataFrame, implements: DataFrame, nodes: DataFrame, k: int = 15) -> DataFrame:
    """(id, name, risk, paragraph, rule, scenarios): the k verified rules of highest risk with the paragraph that implements each and what to test.

    rules (id, name, properties, risk), implements edges (src, dst).  Of several paragraphs the one of greatest id counts; without one the rule stands for itself.
    """
    top = rules.where(verified()).orderBy(F.desc("risk"), "id").limit(k)
    known = nodes.select(F.col("id").alias("src"), F.col("name").alias("paragraph"))
    parents = implements.select("src", F.col("dst").alias("id")).join(F.broadcast(top.select("id")), "id", "left_semi").join(known, "src")  # at most k rules
    parent = parents.groupBy("id").agg(F.max_by("paragraph", "src").alias("paragraph"))
    paragraph = F.coalesce("paragraph", "name")
    scenarios = F.concat(
        F.coalesce(F.from_json(prop("edge_cases"), "array<string>"), F.array().cast("array<string>")),
        F.array(F.concat(F.lit("normal run of "), paragraph), F.lit("boundaries of dates and numbers"), F.concat(F.lit("invalid input to "), paragraph), F.concat(paragraph, F.lit(" within the program that calls it"))),
    )
    return top.join(parent, "id", "left").select("id", "name", F.round("risk", 1).alias("risk"), paragraph.alias("paragraph"), F.substring(F.coalesce(prop("rule"), F.lit("")), 1, 120).alias("rule"), scenarios.alias("scenarios"))


def rule_history(rules: DataFrame, log: DataFrame) -> DataFrame:
    """(id, name, state, n_rows, last_ts) of every rule: changed over time, stable since it was first verified, or unverified."""
    rows = log.where(F.col("type") == "BusinessRule").groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("ts").alias("last_ts"))
    n = F.coalesce("n_rows", F.lit(0))
    return rules.join(rows, "id", "left").select("id", "name", F.when(n > 1, "changed").when(verified(), "stable").otherwise("unverified").alias("state"), n.alias("n_rows"), "last_ts")


def sample(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes that a summary shows: programs, paragraphs and rules first, then by type and name."""
    first = F.when(F.col("type").isin("Program", "Paragraph", "BusinessRule"), 0).otherwise(1)
    return nodes.orderBy(first, "type", F.lower("name"), "id").limit(k).select("id", "type", "name")


def resolve_rule(nodes: DataFrame, asked: str) -> DataFrame:
    """The rule that is meant: the one of that id, else the first whose name contains the text; one row or none."""
    rules = nodes.where(F.col("type") == "BusinessRule")
    tier = F.when(F.col("id") == asked, 1).when(F.contains("name", F.lit(asked)), 2)
    return rules.withColumn("tier", tier).where(F.col("tier").isNotNull()).orderBy("tier", "id").limit(1).drop("tier")


def write_reports(documents: list[DataFrame], folder: str) -> DataFrame:
    """Write the lines of all reports partitioned by category, and a manifest (category, n_lines) beside them; gives the manifest."""
    lines = reduce(DataFrame.unionByName, documents)
    lines.write.mode("overwrite").partitionBy("category").parquet(f"{folder}/reports")
    written = lines.sparkSession.read.schema(lines.schema).parquet(f"{folder}/reports")
    written.groupBy("category").agg(F.count(F.lit(1)).alias("n_lines")).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return lines.sparkSession.read.schema("category string, n_lines bigint").json(f"{folder}/manifest")
