"""Checks of a history of writes and reads; each gives the offending rows, none for a correct history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def not_visible(writes: DataFrame, seen: DataFrame, topics: DataFrame) -> DataFrame:
    """Acknowledged writes below what was read (topics: topic_id, high_watermark, last_read_us) and done before that, but never seen."""
    due = writes.where("success").join(topics, "topic_id").where("offset < high_watermark AND end_us < last_read_us")
    return due.join(seen.select("topic_id", "value"), ["topic_id", "value"], "left_anti").select("topic_id", "offset", "value")


def repeated_offsets(writes: DataFrame) -> DataFrame:
    return writes.where("success").groupBy("topic_id", "offset").agg(F.count("*").alias("n")).where("n > 1")


def falling_watermarks(reads: DataFrame) -> DataFrame:
    before = F.lag("high_watermark").over(Window.partitionBy("reader_id", "topic_id").orderBy("read_no"))
    return reads.withColumn("before", before).where("high_watermark < before").select("reader_id", "topic_id", "read_no", "before", "high_watermark")


def repeated_values(writes: DataFrame) -> DataFrame:
    return writes.where("success").groupBy("topic_id", "value").agg(F.countDistinct("offset").alias("n_offsets")).where("n_offsets > 1")


def gaps_between_polls(reads: DataFrame) -> DataFrame:
    due = F.lag(F.col("requested_offset") + F.col("n_values")).over(Window.partitionBy("reader_id", "topic_id").orderBy("read_no"))
    return reads.withColumn("due", due).where("requested_offset <> due").select("reader_id", "topic_id", "read_no", "due", "requested_offset")


def acausal(writes: DataFrame, bucket_us: int = 60_000_000) -> DataFrame:
    """Writes that begin after another of their topic ended with a larger offset.

    A write is wrong if the largest offset among those that ended before its start is larger than its own. Ends and starts lie on
    one time line: the running maximum over it, in two phases (buckets of time, then within a bucket), replaces the join of
    all pairs. Ends at the time of a start don't count.
    """
    w = writes.where("success")
    ends = w.select("topic_id", F.col("end_us").alias("t"), F.lit(1).alias("o"), "offset", F.lit(None).cast("string").alias("value"), F.col("offset").alias("x"))
    starts = w.select("topic_id", F.col("start_us").alias("t"), F.lit(0).alias("o"), "offset", "value", F.lit(None).cast("long").alias("x"))
    line = ends.unionByName(starts).withColumn("b", F.expr(f"t div {bucket_us}"))
    tops = line.groupBy("topic_id", "b").agg(F.max("x").alias("m"))
    before = F.max("m").over(Window.partitionBy("topic_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    inner = F.max("x").over(Window.partitionBy("topic_id", "b").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0))
    rows = line.withColumn("inner", inner).join(tops.select("topic_id", "b", before.alias("outer")), ["topic_id", "b"])
    return rows.where("o = 0 AND greatest(inner, outer) > offset").select("topic_id", "offset", "value", F.greatest("inner", "outer").alias("larger_before"))


def falling_sends(writes: DataFrame) -> DataFrame:
    before = F.lag("offset").over(Window.partitionBy("writer_id", "topic_id").orderBy("append_seq"))
    return writes.where("success").withColumn("before", before).where("offset <= before").select("writer_id", "topic_id", "append_seq", "before", "offset")


def phantoms(seen: DataFrame, writes: DataFrame) -> DataFrame:
    """Values that were read but never written."""
    return seen.join(writes.select("topic_id", "value"), ["topic_id", "value"], "left_anti").select("topic_id", "value").distinct()
