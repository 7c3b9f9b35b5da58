"""Read path: segment lookup, offset ranges, byte budgets, schema runs, watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.append import running_total

#: Offsets in a block of the two-phase windows.
BLOCK = 65_536


def lookup(index: DataFrame, start: int, end: int | None = None, limit: int = 10) -> DataFrame:
    """Per topic the first `limit` segments that reach beyond start (and begin before end)."""
    found = index.where(F.col("end_offset") > start)
    found = found if end is None else found.where(F.col("start_offset") < end)
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy("start_offset"))
    return found.withColumn("__rank", rank).where(F.col("__rank") <= limit).select("topic_id", "start_offset", "end_offset", "schema_id")


def point_lookup(index: DataFrame, offsets: list[int]) -> DataFrame:
    """The segment that holds each of the offsets, by topic."""
    probe = F.explode(F.array(*(F.lit(o).cast("long") for o in offsets))).alias("probe_offset")
    return index.select("topic_id", probe, "start_offset", "end_offset").where("start_offset <= probe_offset AND probe_offset < end_offset")


def high_watermark(topics: DataFrame, index: DataFrame) -> DataFrame:
    """The next free offset of every topic; 0 without records."""
    top = index.groupBy("topic_id").agg(F.max("end_offset").alias("hw"))
    return topics.select("topic_id").join(top, "topic_id", "left").select("topic_id", F.coalesce("hw", F.lit(0)).cast("long").alias("high_watermark"))


def from_offset(records: DataFrame, start: int, end: int | None = None) -> DataFrame:
    found = records.where(F.col("offset") >= start)
    return (found if end is None else found.where(F.col("offset") < end)).select("topic_id", "offset", "key", "value")


def within_budget(records: DataFrame, start: int, max_bytes: int) -> DataFrame:
    """Records from start on while those before are under max_bytes: the one that crosses is included, so there is one at least.

    Two phases: bytes by blocks of offsets first, then single records of the blocks that begin within the budget. Records without
    a byte cost nothing, so any number of them may be in the answer.
    """
    near = records.where(F.col("offset") >= start).withColumn("__block", F.expr(f"offset div {BLOCK}"))
    sums = near.groupBy("topic_id", "__block").agg(F.sum("size").alias("__sum"))
    ahead = sums.select("topic_id", "__block", (F.sum("__sum").over(Window.partitionBy("topic_id").orderBy("__block")) - F.col("__sum")).alias("__ahead")).where(F.col("__ahead") < max_bytes)
    inner = F.sum("size").over(Window.partitionBy("topic_id", "__block").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = near.join(ahead, ["topic_id", "__block"]).withColumn("running_before", (F.col("__ahead") + inner).cast("long"))
    return rows.select("topic_id", "offset", "size", "running_before").where(F.col("running_before") < max_bytes)


def schema_runs(index: DataFrame, topics: DataFrame) -> DataFrame:
    """Runs of one schema along the offsets of a topic (gaps and islands), over segments: a segment has one schema.

    Two phases: a block of offsets takes the schema before it from the last segment of the block before, then runs are numbered by a
    running total of the changes. A topic without segments has one row: schema 0, no records.
    """
    rows = index.withColumn("__block", F.expr(f"start_offset div {BLOCK}"))
    last = rows.groupBy("topic_id", "__block").agg(F.max_by("schema_id", "start_offset").alias("__last"))
    before = last.select("topic_id", "__block", F.lag("__last").over(Window.partitionBy("topic_id").orderBy("__block")).alias("__prior"))
    own = F.coalesce(F.lag("schema_id").over(Window.partitionBy("topic_id", "__block").orderBy("start_offset")), "__prior")
    rows = rows.join(before, ["topic_id", "__block"]).withColumn("__change", F.when(F.col("schema_id") == own, 0).otherwise(1))
    rows = running_total(rows, "topic_id", "__block", ["start_offset"], "__change", "run_no")
    runs = rows.groupBy("topic_id", "run_no", "schema_id").agg(F.min("start_offset").alias("first_offset"), (F.max("end_offset") - 1).alias("last_offset"), F.sum("record_count").alias("n"))
    number = lambda n: F.lit(n).cast("long")
    none = topics.select("topic_id").join(index.select("topic_id").distinct(), "topic_id", "left_anti").select("topic_id", number(1).alias("run_no"), number(0).alias("schema_id"), number(0).alias("first_offset"), number(-1).alias("last_offset"), number(0).alias("n"))
    return runs.unionByName(none).join(high_watermark(topics, index), "topic_id")


def tail(records: DataFrame, n: int) -> DataFrame:
    """The last n records by arrival, newest first."""
    return records.orderBy(F.col("event_id").desc()).limit(n).select("event_id", "topic_id", "offset", "key", "value")


def display(records: DataFrame) -> DataFrame:
    """offset, key, value as text; a value that doesn't parse stays as it is."""
    n = F.try_variant_get(F.try_parse_json("value"), "$.k", "bigint")
    return records.select("topic_id", "offset", "key", "value", n.alias("k"), F.try_parse_json("value").isNotNull().alias("decoded"))
