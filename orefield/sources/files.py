"""Scanning a tree of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of each kind of source; a file may also be of kinds that its content tells (see CONTENT).
SUFFIXES = {"cobol": ("cbl", "cob"), "vsam": ("cbl", "cob"), "copybook": ("cpy", "copy"), "jcl": ("jcl",), "bms": ("bms", "map", "cbs")}
CONTENT = {
    "ddl": r"(?i)CREATE\s+(TABLE|VIEW|INDEX|TRIGGER|PROCEDURE|FUNCTION)\b",
    "sqlpl": r"(?i)CREATE\s+(PROCEDURE|FUNCTION)\b",
    "trigger": r"(?i)CREATE\s+TRIGGER\b",
    "cics": r"(?i)EXEC\s+CICS\s+(SEND|RECEIVE)\s+MAP",
}


def read_tree(spark: SparkSession, path: str, codebase_id: str = "default", max_bytes: int = 1 << 28) -> DataFrame:
    """(source_file, text, codebase_id) of every file under ``path``.

    Bytes that are no UTF-8 become U+FFFD, line ends become line feeds.  Files larger than ``max_bytes``, which
    no task could hold, are listed with a null text and never read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.regexp_replace(F.expr("make_valid_utf8(cast(content as string))"), "\r\n|\r", "\n")
    small = raw.where(F.col("length") <= max_bytes).select(F.col("path").alias("source_file"), text.alias("text"))
    large = raw.where(F.col("length") > max_bytes).select(F.col("path").alias("source_file"), F.lit(None).cast("string").alias("text"))
    return small.unionByName(large).withColumn("codebase_id", F.lit(codebase_id))


def suffix(source_file: Column) -> Column:
    return F.lower(F.regexp_extract(source_file, r"\.([A-Za-z0-9]+)$", 1))


def stem(source_file: Column) -> Column:
    return F.regexp_extract(source_file, r"([^/]*?)(?:\.[^./]*)?$", 1)


def of_kind(files: DataFrame, kind: str) -> DataFrame:
    """Files that the extractor of this kind handles; one file may be of several kinds."""
    if kind in SUFFIXES:
        return files.where(suffix(F.col("source_file")).isin(*SUFFIXES[kind]))
    ddl_like = files.where(~suffix(F.col("source_file")).isin("cbl", "cob", "cpy", "copy", "jcl", "bms", "map")) if kind != "cics" else files.where(suffix(F.col("source_file")).isin("cbl", "cob"))
    return ddl_like.where(F.col("text").rlike(CONTENT[kind]))
