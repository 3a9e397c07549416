"""Narrating code units through an exchangeable model: redaction first, then only what is new.

Texts reach a narrator redacted; equal redacted texts are narrated once and the result is handed to all
units that share it.  What was narrated before is left out by an anti-join on the hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.functions.text import REDACTIONS, content_hash, redact
from orefield.plans.lineage import cut

#: The reply of the deterministic narrator.
MOCK_RULE = "Business rule for {}: performs standard data processing with conditional branching."
MOCK_EDGE_CASE = "Review edge case around date boundary crossing"


class Narrator(Protocol):
    """One client per partition; texts in, JSON replies out."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def gated(units: DataFrame, *more: str, patterns: Sequence[tuple[str, str]] = REDACTIONS) -> DataFrame:
    """(unit_id, kind, name, redacted, hash) and the columns asked for: the only form in which units reach a narrator.

    Without any pattern to redact by, nothing is let through.
    """
    if not patterns:
        raise ValueError("units reach a narrator redacted only")
    text = redact(F.col("source"), patterns)
    return units.where(F.coalesce("source", F.lit("")) != "").select("unit_id", "kind", "name", *more, text.alias("redacted")).withColumn("hash", content_hash(F.col("redacted")))


def prompt(kind: Column, name: Column, text: Column) -> Column:
    return F.concat(F.lit("Artifact type: "), kind, F.lit("\nUnit name: "), name, F.lit("\n\nSource:\n"), text, F.lit("\n\nDescribe the rule this code encodes as JSON."))


def to_narrate(units: DataFrame, narrations: DataFrame) -> DataFrame:
    """(hash, kind, name, redacted, n_units): distinct redacted texts of units, or of what ``gated`` made of them, that no valid narration covers, each with its least unit."""
    made = units if {"redacted", "hash"} <= set(units.columns) else gated(units)
    known = narrations.where(~F.coalesce("stale", F.lit(False))).select(F.col("content_hash").alias("hash"))
    first = F.min_by(F.struct("kind", "name", "redacted"), "unit_id")
    return made.join(known, "hash", "left_anti").groupBy("hash").agg(first.alias("u"), F.count(F.lit(1)).alias("n_units")).select("hash", "u.kind", "u.name", "u.redacted", "n_units")


def mock_reply(name: Column, text: Column) -> Column:
    """Reply of the deterministic narrator as JSON, as a column expression."""
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.to_json(F.struct(
        F.format_string(MOCK_RULE.replace("{}", "%s"), name).alias("rule"), F.lit(0.5).alias("confidence"),
        F.array(F.lit(1), F.greatest(F.lit(1), n_lines)).alias("line_range"), F.array(F.lit(MOCK_EDGE_CASE)).alias("edge_cases"),
    ))


def reply_tokens(reply: Column) -> Column:
    return (F.floor(F.length(reply) / 4) + 1).cast("bigint")


def narrate(todo: DataFrame, open_narrator: Callable[[], Narrator] | None = None) -> DataFrame:
    """(hash, reply): by the given narrator, opened once per partition, or by the deterministic one."""
    if open_narrator is None:
        return todo.select("hash", mock_reply(F.col("name"), F.col("redacted")).alias("reply"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        narrator = open_narrator()
        for b in batches:
            yield pd.DataFrame({"hash": b["hash"], "reply": narrator(b["prompt"].tolist())})

    return todo.select("hash", prompt(F.col("kind"), F.col("name"), F.col("redacted")).alias("prompt")).mapInPandas(run, "hash string, reply string")


def parsed(reply: Column) -> Column:
    """(rule, confidence, line_range, edge_cases) of a reply, code fences removed; what is no JSON becomes a rule of confidence 0."""
    bare = F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*|\s*```$", "")
    kind = "struct<rule:string,confidence:double,line_range:array<int>,edge_cases:array<string>>"
    good = F.from_json(bare, kind)
    none = F.struct(F.substring(bare, 1, 500).alias("rule"), F.lit(0.0).alias("confidence"), F.lit(None).cast("array<int>").alias("line_range"), F.array(F.lit("parse_failed")).alias("edge_cases"))
    return F.when(good["rule"].isNotNull(), good).otherwise(none)


def spent_before(items: DataFrame, tokens: str, order: list) -> DataFrame:
    """Items with ``spent``: tokens of all items before them in the order.

    Two levels, so that no task sees all items: sums within ranges of the order, then sums over ranges.
    The bounds of the ranges are sampled, so the rows are written with the number of their range: computed
    twice, the numbers could differ.
    """
    ranged = cut(items.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    # The order of ranges is the order of partitions; one row per partition goes through the second window.
    sums = ranged.groupBy("part").agg(F.sum(tokens).alias("part_sum"))
    before = sums.withColumn("before", F.coalesce(F.sum("part_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inner = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(before), "part", "left").withColumn("spent", F.col("before") + F.coalesce(F.sum(tokens).over(inner), F.lit(0))).drop("part", "before")


def rule_nodes(units: DataFrame, replies: DataFrame, codebase: Column) -> tuple[DataFrame, DataFrame]:
    """Rule nodes and IMPLEMENTS_RULE edges of all units that share a narrated text (units: gated, with ``node_id``)."""
    made = units.join(replies, "hash")
    rule_id = F.concat(F.lit("BusinessRule:"), codebase, F.lit(":"), F.col("name"), F.lit(":"), F.substring("hash", 1, 8))
    nodes = made.select(rule_id.alias("id"), F.lit("BusinessRule").alias("type"), F.concat(F.lit("Rule for "), F.col("name")).alias("name"), F.col("hash").alias("content_hash"), F.col("reply").alias("properties")).dropDuplicates(["id"])
    return nodes, made.select(F.col("node_id").alias("src"), rule_id.alias("dst"), F.lit("IMPLEMENTS_RULE").alias("type"))


def totals(made: DataFrame, narrations: DataFrame, tokens: Column) -> DataFrame:
    """One row over the outcomes of a run on ``gated`` units: texts created, units served by them or from before, tokens spent, units with redactions, units skipped as repeats.

    ``tokens`` is computed once per text that is narrated.
    """
    todo = to_narrate(made, narrations)
    new = todo.agg(F.count(F.lit(1)).alias("created"), F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("tokens"), F.coalesce(F.sum(F.col("n_units") - 1), F.lit(0)).alias("repeats"))
    known = narrations.where(~F.coalesce("stale", F.lit(False))).select(F.col("content_hash").alias("hash"))
    old = made.join(known, "hash", "left_semi").agg(F.count(F.lit(1)).alias("cache_hits"))
    hidden = made.agg(F.count_if(F.contains("redacted", F.lit("[REDACTED]"))).alias("redacted"))
    one = lambda df: df.withColumn("__one", F.lit(1))  # noqa: E731  # one row on either side
    return one(new).join(one(old), "__one").join(one(hidden), "__one").select("created", "cache_hits", "tokens", "redacted", "repeats")
