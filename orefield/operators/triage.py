"""Risk, differences, duplicates and budgeted work lists of code units."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.functions.model import prop_count, prop_number
from orefield.functions.text import content_hash, redact, token_estimate
from orefield.operators.graph import depths


@dataclass(frozen=True)
class RiskProfile:
    """Weights of the risk score (fixed values)."""

    complexity: float = 0.5
    goto_density: float = 0.2
    external_calls: float = 0.15
    undocumented_literals: float = 0.1
    cascade: float = 0.5
    trigger_chain: float = 0.8


def risk_score(profile: RiskProfile = RiskProfile()) -> Column:
    """Weighted sum of the properties of a node, within 0 and 20; a third of it where the parser was in doubt."""
    raw = (
        prop_number("cyclomatic_complexity") * profile.complexity + prop_number("goto_density") * profile.goto_density
        + prop_count("external_calls") * profile.external_calls + prop_count("undocumented_literals") * profile.undocumented_literals
    )
    return F.least(F.lit(20.0), F.greatest(F.lit(0.0), raw)) * F.when(F.coalesce("parse_confidence", F.lit(1.0)) < 0.5, 0.3).otherwise(1.0)


def scored(nodes: DataFrame, edges: DataFrame, profile: RiskProfile = RiskProfile()) -> DataFrame:
    """Nodes with ``risk``: the score, plus cascade depth for tables and chain depth for triggers."""
    cascades = F.col("kind") == "CASCADES_TO"
    depth = depths(edges, nodes, ["CASCADES_TO", "TRIGGERS_TRIGGER"]).select(
        "id", F.when(cascades, "DB2Table").otherwise("Trigger").alias("type"), (F.col("depth") * F.when(cascades, profile.cascade).otherwise(profile.trigger_chain)).alias("extra"),
    )
    return nodes.join(depth, ["id", "type"], "left").withColumn("risk", F.round(risk_score(profile) + F.coalesce("extra", F.lit(0.0)), 6)).drop("extra")


def top_risks(risky: DataFrame, k: int) -> DataFrame:
    return risky.orderBy(F.desc("risk"), "id").limit(k).select("id", "type", "name", F.round("risk", 2).alias("risk"))


def risk_bands(risky: DataFrame) -> DataFrame:
    """Numbers of nodes with some risk in three bands."""
    r = F.col("risk")
    return risky.where(r > 0).agg(F.count_if(r >= 5).alias("high"), F.count_if((r >= 2) & (r < 5)).alias("medium"), F.count_if(r < 2).alias("low"))


def duplicates(units: DataFrame) -> DataFrame:
    """(hash, n_units, first_unit): groups of units whose text is the same but for blanks at line ends."""
    return (
        units.where(F.col("source").isNotNull()).select("unit_id", content_hash(F.col("source")).alias("hash"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("n_units"), F.min("unit_id").alias("first_unit"))
    )


def unit_changes(units: DataFrame, known: DataFrame) -> DataFrame:
    """(node_id, status) of units against stored nodes: added, changed or unchanged; removed ones are not reported."""
    status = F.when(F.col("known_hash").isNull(), "added").when(F.col("known_hash") == F.col("content_hash"), "unchanged").otherwise("changed")
    stored = known.select(F.col("id").alias("node_id"), F.coalesce("content_hash", F.lit("")).alias("known_hash"))
    return units.select("node_id", "content_hash").join(stored, "node_id", "left").select("node_id", status.alias("status"))


def candidates(paragraphs: DataFrame, implements: DataFrame, rules: DataFrame, narrations: DataFrame) -> DataFrame:
    """(id, hash, reason): paragraphs whose rule is missing (new), out of date (changed) or marked stale; those up to date are left out.

    paragraphs (id, source), implements edges (src, dst), rules (id, content_hash), narrations (content_hash, stale).
    """
    p = paragraphs.where(F.coalesce("source", F.lit("")) != "").select("id", content_hash(redact(F.col("source"))).alias("hash"))
    n = narrations.select(F.col("content_hash").alias("rule_hash"), "stale")
    r = rules.select(F.col("id").alias("dst"), F.col("content_hash").alias("rule_hash")).join(n, "rule_hash", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    linked = implements.select(F.col("src").alias("id"), "dst").join(r, "dst", "left")
    judged = p.join(linked, "id", "left").groupBy("id", "hash").agg(
        F.count("dst").alias("n_links"), F.coalesce(F.bool_or((F.col("rule_hash") == F.col("hash")) & ~F.col("stale")), F.lit(False)).alias("current"),
        F.coalesce(F.bool_or("stale"), F.lit(False)).alias("stale"),
    )
    return judged.where(~F.col("current")).select("id", "hash", F.when(F.col("n_links") == 0, "new").when(F.col("stale"), "stale").otherwise("changed").alias("reason"))


def work_items(units: DataFrame, risky: DataFrame) -> DataFrame:
    """(node_id, risk, tokens): units that belong to a node, with its risk."""
    u = units.select("node_id", token_estimate(F.col("source")).alias("tokens"))
    return u.join(risky.select(F.col("id").alias("node_id"), "risk"), "node_id").select("node_id", "risk", "tokens")


def work_queue(paragraphs: DataFrame, implements: DataFrame, rules: DataFrame, narrations: DataFrame, risky: DataFrame, budget: int = 50_000, threshold: float = 3.0) -> DataFrame:
    """(node_id, risk, tokens, reason): what to narrate again within the budget: paragraphs whose rule changed or is stale (new ones are not queued), by falling risk."""
    again = candidates(paragraphs, implements, rules, narrations).where(F.col("reason") != "new").select(F.col("id").alias("node_id"), "reason")
    sized = paragraphs.select(F.col("id").alias("node_id"), F.col("source")).join(again, "node_id")
    chosen = within_budget(work_items(sized, risky), budget, threshold)
    return chosen.join(again, "node_id")


def within_budget(items: DataFrame, budget: int, threshold: float = 0.0) -> DataFrame:
    """Greedy choice by falling risk: an item that no longer fits is passed over and smaller ones are still tried.

    Items that cannot be chosen never reach the single fold: those below the threshold or larger than the
    budget, and of the items of one size t all but the first budget / t in order, for more can never fit.
    So the fold sees at most budget * (1 + 1/2 + ... + 1/budget) rows, whatever the size of the table.
    A size that very many items share is first cut down in 64 parts.
    """
    able = items.where((F.col("risk") >= threshold) & (F.col("tokens") <= budget))
    for group in (["tokens", F.pmod(F.xxhash64("node_id"), F.lit(64))], ["tokens"]):
        by_size = Window.partitionBy(*group).orderBy(F.desc("risk"), "node_id")
        able = able.withColumn("nth", F.row_number().over(by_size)).where(F.col("nth") * F.col("tokens") <= budget).drop("nth")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["risk", "node_id"], ascending=[False, True])
        left, keep = budget, []
        for tokens in group["tokens"]:
            take = tokens <= left
            left -= tokens if take else 0
            keep.append(take)
        return group[keep]

    columns = ["node_id", "risk", "tokens"]
    schema = items.select(*columns).schema
    return able.select(*columns, F.lit(0).alias("fold")).groupBy("fold").applyInPandas(lambda g: fold(g[columns]), schema)
