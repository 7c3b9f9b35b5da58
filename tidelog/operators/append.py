"""Append path: coalescing, dedup decisions, merging, gap-free offsets, acks, writer state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Flushes summed together before the running total goes over them: a topic's prefix sum then is one row per so many flushes.
COARSE = 256


def running_total(df: DataFrame, key: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with out: the sum of value over the earlier and own rows of key in (bucket, order).

    In two phases, so that no key meets in one task: sums by (key, bucket) are small and get the running total; rows are
    numbered within their bucket only. bucket must not decrease along the order.
    """
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias("__sum"))
    before = sums.select(key, bucket, (F.sum("__sum").over(Window.partitionBy(key).orderBy(bucket)) - F.col("__sum")).alias("__before"))
    inner = F.sum(value).over(Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__inner", inner).join(before, [key, bucket]).withColumn(out, (F.col("__before") + F.col("__inner")).cast("long")).drop("__before", "__inner")


def segments(log: DataFrame) -> DataFrame:
    """One row per (flush, topic, schema) with its offsets (gap-free per topic, end exclusive), place in the flush's object, ingest time.

    log: topic_id, flush_id, schema_id, size, ts_us.
    """
    seg = log.groupBy("topic_id", "flush_id", "schema_id").agg(F.count("*").alias("record_count"), F.sum("size").alias("byte_length"), F.max("ts_us").alias("__last"))
    seg = seg.withColumn("__coarse", F.expr(f"flush_id div {COARSE}"))
    seg = running_total(seg, "topic_id", "__coarse", ["flush_id", "schema_id"], "record_count", "end_offset").drop("__coarse")
    flush = Window.partitionBy("flush_id")
    place = F.sum("byte_length").over(flush.orderBy("topic_id", "schema_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("byte_length")
    return seg.select(
        "topic_id", "flush_id", "schema_id", (F.col("end_offset") - F.col("record_count")).alias("start_offset"), "end_offset", "record_count",
        place.cast("long").alias("byte_offset"), "byte_length", F.max("__last").over(flush).alias("ingest_us"),
    )


def running_max_before(df: DataFrame, key: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with out: the maximum of value over the earlier rows of key in (bucket, order); in two phases, as running_total."""
    tops = df.groupBy(key, bucket).agg(F.max(value).alias("__top"))
    outer = F.max("__top").over(Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    inner = F.max(value).over(Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__inner", inner).join(tops.select(key, bucket, outer.alias("__outer")), [key, bucket]).withColumn(out, F.greatest("__inner", "__outer")).drop("__inner", "__outer")


def places(requests: DataFrame) -> DataFrame:
    """requests with place (of its first record in its segment) and n_records: 1 each unless the requests tell (record_count)."""
    n = F.col("record_count") if "record_count" in requests.columns else F.lit(1)
    before = F.sum("n_records").over(Window.partitionBy("flush_id", "topic_id", "schema_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("n_records", n.cast("long")).withColumn("place", (before - F.col("n_records")).cast("long"))


def merged(requests: DataFrame) -> DataFrame:
    """flush_id, topic_id, schema_id, writer_id, start_idx, record_count: where a writer's first record lies in its segment."""
    return places(requests).groupBy("flush_id", "topic_id", "schema_id", "writer_id").agg(F.min("place").alias("start_idx"), F.sum("n_records").alias("record_count"))


def coalesced(arrivals: DataFrame) -> DataFrame:
    """Requests of one flush that share writer and sequence number, with their number."""
    return arrivals.groupBy("flush_id", "writer_id", "append_seq").agg(F.count("*").alias("n_requests"))


def classified(arrivals: DataFrame, pipelined: bool = False) -> DataFrame:
    """arrival, writer_id, append_seq, decision against the largest sequence number before: ACCEPT, DUPLICATE or STALE.

    pipelined: a stale request passes if a larger number of the writer arrives later in its flush.
    """
    later = F.max("append_seq").over(Window.partitionBy("writer_id", "flush_id").orderBy("arrival").rowsBetween(1, Window.unboundedFollowing))
    rows = running_max_before(arrivals, "writer_id", "flush_id", ["arrival"], "append_seq", "last").withColumn("later", later)
    stale = F.when(F.col("later") > F.col("append_seq"), "ACCEPT").otherwise("STALE") if pipelined else F.lit("STALE")
    seq = F.col("append_seq")
    decision = F.when(F.col("last").isNull() | (seq > F.col("last")), "ACCEPT").when(seq == F.col("last"), "DUPLICATE").otherwise(stale)
    return rows.select("arrival", "writer_id", "append_seq", decision.alias("decision"))


def acks(requests: DataFrame, index: DataFrame) -> DataFrame:
    """The offsets [start, end) that each request got in its segment: as many as it has records."""
    at = index.select("topic_id", "flush_id", "schema_id", F.col("start_offset").alias("__start"))
    rows = places(requests).join(at, ["topic_id", "flush_id", "schema_id"])
    start = (F.col("__start") + F.col("place")).cast("long")
    return rows.select("writer_id", "append_seq", "topic_id", "schema_id", start.alias("start_offset"), (start + F.col("n_records")).alias("end_offset"))


def writer_state(old: DataFrame, accepted: DataFrame) -> DataFrame:
    """writer_id, last_seq: old state moved on by accepted requests, never back."""
    return old.unionByName(accepted.groupBy("writer_id").agg(F.max("append_seq").alias("last_seq"))).groupBy("writer_id").agg(F.max("last_seq").alias("last_seq"))


def writer_acks(old: DataFrame, acked: DataFrame) -> DataFrame:
    """writer_id, last_seq, last_start, last_end: the acknowledged range of each writer's highest sequence number.

    old: these columns; acked: the rows of acks. State moves on, never back; of equal numbers the old state's acknowledgement
    stays, then the one with the smaller start (it was given first)."""
    new = acked.groupBy("writer_id").agg(F.max(F.struct(F.col("append_seq").alias("s"), (-F.col("start_offset")).alias("x"), F.col("end_offset").alias("e"))).alias("m"))
    new = new.select("writer_id", F.col("m.s").alias("last_seq"), (-F.col("m.x")).alias("last_start"), F.col("m.e").alias("last_end"), F.lit(0).alias("was"))
    both = old.withColumn("was", F.lit(1)).unionByName(new)
    best = both.groupBy("writer_id").agg(F.max(F.struct("last_seq", "was", "last_start", "last_end")).alias("m"))
    return best.select("writer_id", "m.last_seq", "m.last_start", "m.last_end")


def answered(arrivals: DataFrame, state: DataFrame, fail_open: bool = True) -> DataFrame:
    """arrival, writer_id, append_seq, decision, start_offset, end_offset against the stored state of writer_acks: a DUPLICATE is answered
    with the stored acknowledgement. A writer whose state can't be read (column failed of the state) is accepted if fail_open, else ERROR."""
    failed = F.col("failed") if "failed" in state.columns else F.lit(False)
    rows = arrivals.join(state.withColumn("__failed", failed).select("writer_id", "last_seq", "last_start", "last_end", "__failed"), "writer_id", "left")
    seq = F.col("append_seq")
    decision = F.when(F.col("__failed"), "ACCEPT" if fail_open else "ERROR").when(F.col("last_seq").isNull() | (seq > F.col("last_seq")), "ACCEPT").when(seq == F.col("last_seq"), "DUPLICATE").otherwise("STALE")
    rows = rows.withColumn("decision", decision)
    known = F.col("decision") == "DUPLICATE"
    return rows.select("arrival", "writer_id", "append_seq", "decision", F.when(known, F.col("last_start")).alias("start_offset"), F.when(known, F.col("last_end")).alias("end_offset"))


def bytes_by_writer(log: DataFrame) -> DataFrame:
    return log.groupBy("writer_id").agg(F.sum("size").alias("bytes"))
