"""Registered queries of the training-data operators (p1, p3, p6 to p9) and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm import credentials, encoding, leaks, near, quality, syntax
from orefield.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.found_lines(table(spark, d, "units"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Sources that held credentials, with only the values replaced."""
    found = credentials.with_findings(table(spark, d, "units").select("unit_id", "kind", "source"), kind="kind")
    return found.select("unit_id", F.size("credentials").cast("bigint").alias("n_redacted"), credentials.redacted(F.col("source"), F.col("credentials")).alias("source"))


def p1_missed(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: credentials found, and how many of them the existing reports do not cover."""
    found = credentials.with_findings(table(spark, d, "units").select("unit_id", "kind", "source"), kind="kind").select("unit_id", F.explode("credentials").alias("c"))
    reported = table(spark, d, "redaction_reports").groupBy("unit_id").agg(F.flatten(F.collect_list("findings")).alias("reported"))
    covered = F.coalesce(F.exists("reported", lambda r: (r["span_start"] < F.col("c.span_end")) & (F.col("c.span_start") < r["span_end"])), F.lit(False))
    return found.join(reported, "unit_id", "left").groupBy(F.col("c.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n_found"), F.count_if(~covered).alias("n_missed"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(table(spark, d, "units"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every unit with its class of equal texts and the number of similar classes."""
    return near.near_classes(table(spark, d, "units"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_files(table(spark, d, "source_files"))


def p6_faults(spark: SparkSession, d: str) -> DataFrame:
    return syntax.checked(table(spark, d, "source_files"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "source_files"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text again, from its token ids."""
    return encoding.decode(encoding.encode(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p8_stages(spark: SparkSession, d: str) -> DataFrame:
    """What each stage leaves: candidates by fingerprint, similar by shingles, pairs that hold a passage; per size of window."""
    return leaks.stages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"))


def p9_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts against the labels of the raters."""
    return quality.agreement(table(spark, d, "documents"), table(spark, d, "doc_labels"))


_LEAKS = """
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
hits AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run))"""

_SHINGLES = """
WITH u AS (SELECT unit_id, list_transform(regexp_extract_all(source, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM units WHERE source IS NOT NULL),
s AS (SELECT DISTINCT unit_id, array_to_string(w[k : k + 2], ' ') AS shingle FROM (SELECT unit_id, w, unnest(range(1, len(w) - 1)) AS k FROM u)),
n AS (SELECT unit_id, count(*) AS n, md5(string_agg(shingle, '|' ORDER BY shingle)) AS class FROM s GROUP BY 1),
c AS (SELECT class, min(unit_id) AS class_id, any_value(n) AS n, count(*) AS n_copies FROM n GROUP BY 1),
cs AS (SELECT class_id, n, shingle FROM c JOIN s ON s.unit_id = c.class_id),
p AS (SELECT x.class_id AS a, y.class_id AS b FROM cs x JOIN cs y ON x.shingle = y.shingle AND x.class_id < y.class_id
  GROUP BY x.class_id, y.class_id, x.n, y.n HAVING count(*) >= 0.7 * (x.n + y.n - count(*)) - 1e-9),
m AS (SELECT unit_id, class_id, n_copies FROM n JOIN c USING (class))"""

QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p1_missed": p1_missed,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p6_found": p6_found,
    "p6_faults": p6_faults,
    "p6_rates": p6_rates,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p8_stages": p8_stages,
    "p9_found": p9_found,
    "p9_statistics": p9_statistics,
    "p9_agreement": p9_agreement,
}
SQL: dict[str, str] = {
    "p3_found": f"""{_SHINGLES}
SELECT least(x.unit_id, y.unit_id) AS unit_id_a, greatest(x.unit_id, y.unit_id) AS unit_id_b FROM p JOIN m x ON x.class_id = p.a JOIN m y ON y.class_id = p.b
UNION ALL SELECT x.unit_id, y.unit_id FROM m x JOIN m y ON x.class_id = y.class_id AND x.unit_id < y.unit_id""",
    "p3_classes": f"""{_SHINGLES}, d AS (SELECT class_id, count(*) AS n_links FROM (SELECT a AS class_id FROM p UNION ALL SELECT b FROM p) GROUP BY 1)
SELECT m.unit_id, m.class_id, m.n_copies, coalesce(d.n_links, 0) AS n_links FROM m LEFT JOIN d USING (class_id)""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_found": f"{_LEAKS} SELECT doc_id, item_id FROM hits",
    "p8_items": f"{_LEAKS} SELECT item_id, count(*) AS n_documents FROM hits GROUP BY 1",
}
