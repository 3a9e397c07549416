"""History of changing entity attributes: versions with the period in which each was valid.

Gaps and islands: among the rows that say something about an entity, those whose attribute differs
from that of the row before (lag) begin an island; a running sum numbers the islands; the minimum time
of an island and the start of the next one give its validity.

An entity with very many rows is cut into slices of time.  Slices are compared among themselves on
one row per slice, so that no task holds all rows of an entity.

Defined cases: rows without id or time are ignored; an operation that is null counts as an update; a
row without attribute changes nothing unless it deletes; a null sequence number counts as the lowest;
rows equal in id, operation, attribute and time count once, at the lowest sequence number, and of the
rows of one id and time only the highest remaining one counts; an entity of which only deletions are
known has no version; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orefield.plans.skew import heavy_keys
from orefield.sources.tables import micros

LOWEST = -(2**63)


def statements(log: DataFrame, id_: str = "id", value: str = "content_hash", op: str = "op", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """(id, at, state): the one row that counts per id and time; state is null where it deletes."""
    rows = log.select(
        F.col(id_).alias("id"), micros(log, ts).alias("at"), F.col(value).alias("value"),
        F.lower(F.btrim(F.coalesce(F.col(op), F.lit("update")), F.lit(" \t\r\n"))).alias("op"), F.coalesce(F.col(seq), F.lit(LOWEST)).cast("bigint").alias("seq"),
    ).where(F.col("id").isNotNull() & F.col("at").isNotNull())
    return (
        rows.repartition("id", "at")  # serves both aggregations, and a busy id is spread by its times
        .groupBy("id", "at", "op", "value").agg(F.min("seq").alias("seq"))
        .groupBy("id", "at").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
        .where((F.col("last.op") == "delete") | F.col("last.value").isNotNull())
        .select("id", "at", F.when(F.col("last.op") != "delete", F.col("last.value")).alias("state"))
    )


def _islands_of_ids(rows: DataFrame) -> DataFrame:
    by_time = Window.partitionBy("id").orderBy("at")
    return (
        rows.withColumn("changed", ~F.col("state").eqNullSafe(F.lag("state").over(by_time)))
        .withColumn("island", F.sum(F.col("changed").cast("bigint")).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
        .where("island > 0")
        .groupBy("id", "island").agg(F.min("at").alias("valid_from"), F.min("state").alias("state"))
        .withColumn("valid_to", F.coalesce(F.lead("valid_from").over(Window.partitionBy("id").orderBy("island")), F.lit(-1)))
        .where(F.col("state").isNotNull())
        .select("id", F.row_number().over(Window.partitionBy("id").orderBy("island")).cast("bigint").alias("version_no"), "valid_from", "valid_to", "state")
    )


def _islands_by_slice(rows: DataFrame, slice_us: int) -> DataFrame:
    """The same for ids with very many rows: first within slices of time, then between slices."""
    rows = rows.withColumn("slice", F.floor(F.col("at") / slice_us))
    in_slice = Window.partitionBy("id", "slice").orderBy("at")
    between = Window.partitionBy("id").orderBy("slice")

    def edges_of(df: DataFrame, first: str, *extra) -> DataFrame:
        return df.groupBy("id", "slice").agg(F.min_by(F.struct(first), "at").alias("head"), F.max_by(F.struct(first), "at").alias("tail"), *extra)

    # State before each slice, from one row per slice.
    before = edges_of(rows, "state").select("id", "slice", F.lag("tail").over(between)["state"].alias("before"))
    starts = (
        rows.join(before, ["id", "slice"])
        .withColumn("previous", F.when(F.row_number().over(in_slice) == 1, F.col("before")).otherwise(F.lag("state").over(in_slice)))
        .where(~F.col("state").eqNullSafe(F.col("previous")))
        .select("id", "slice", "at", "state")
    )
    # Start of the next island and number of versions before each slice, again from one row per slice.
    around = starts.groupBy("id", "slice").agg(F.min("at").alias("head"), F.count("state").alias("n")).select(
        "id", "slice", F.lead("head").over(between).alias("after"),
        F.coalesce(F.sum("n").over(between.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
    )
    return (
        starts.join(around, ["id", "slice"])
        .withColumn("valid_to", F.coalesce(F.lead("at").over(in_slice), F.col("after"), F.lit(-1)))
        .withColumn("version_no", F.col("earlier") + F.count("state").over(in_slice.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("state").isNotNull())
        .select("id", "version_no", F.col("at").alias("valid_from"), "valid_to", "state")
    )


def versions(
    log: DataFrame, id_: str = "id", value: str = "content_hash", op: str = "op", ts: str = "ts", seq: str = "seq",
    *, hot_rows: int = 200_000, slice_us: int = 86_400_000_000,
) -> DataFrame:
    """(id, version_no, valid_from, valid_to, state): every version; times in microseconds, valid_to excluded, -1 while valid.

    ``hot_rows``: rows from which on an id is cut into slices of ``slice_us`` microseconds.
    """
    rows = statements(log, id_, value, op, ts, seq)
    hot = heavy_keys(log, id_, min_rows=hot_rows)
    if not hot:
        return _islands_of_ids(rows)
    is_hot = F.col("id").isin(hot)
    return _islands_of_ids(rows.where(~is_hot)).unionByName(_islands_by_slice(rows.where(is_hot), slice_us))
