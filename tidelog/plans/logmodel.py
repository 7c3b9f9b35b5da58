"""The test tables seen as a log: one topic per event type, flushes of 64 events, schemas in long runs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.scalar import micros, record_size
from tidelog.operators.append import segments

LEASE_US, SESSION_US, MAX_INFLIGHT = 45_000_000, 30_000_000, 10


class LogModel:
    """Lazy DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def topics(self) -> DataFrame:
        """topic_id, topic: event types numbered alphabetically from 1 (a catalogue: one row per type)."""
        types = self.table("events").select(F.col("event_type").alias("topic")).distinct()
        return types.select(F.row_number().over(Window.orderBy("topic")).cast("long").alias("topic_id"), "topic")

    @cached_property
    def log(self) -> DataFrame:
        """One row per event in arrival order event_id."""
        e = self.table("events")
        key = F.col("user_id").cast("string")
        rows = e.select(
            "event_id", micros(F.col("ts")).alias("ts_us"), F.col("event_type").alias("topic"), F.expr("event_id div 64").alias("flush_id"), F.expr("100 + (event_id div 500) % 3").cast("long").alias("schema_id"),
            F.col("user_id").alias("writer_id"), key.alias("key"), F.col("props").alias("value"), record_size(key, F.col("props")).alias("size"),
        )
        return rows.join(self.topics, "topic")

    @cached_property
    def requests(self) -> DataFrame:
        """log with append_seq: the place of the event among its writer's."""
        return self.log.withColumn("append_seq", F.row_number().over(Window.partitionBy("writer_id").orderBy("event_id")).cast("long"))

    @cached_property
    def arrivals(self) -> DataFrame:
        """Requests and their retries: arrival_key orders them; flush from the shifted event id."""
        r = self.requests.select("event_id", "writer_id", "append_seq", "topic_id", "schema_id")
        part = lambda df, kind, shift: df.select("*", F.lit(kind).cast("long").alias("kind"), (F.col("event_id") + shift).alias("at"))
        every = part(r, 0, 0).unionByName(part(r.where("event_id % 7 = 0"), 1, 3)).unionByName(part(r.where("event_id % 11 = 0"), 2, 40))
        return every.withColumn("arrival", F.col("at") * 4 + F.col("kind")).withColumn("flush_id", F.expr("at div 64"))

    @cached_property
    def index(self) -> DataFrame:
        """The segment index: one row per (flush, topic, schema)."""
        return segments(self.log).withColumn("batch_id", F.col("flush_id") * 1000 + F.col("topic_id") * 10 + F.col("schema_id") - 100)

    @cached_property
    def records(self) -> DataFrame:
        """log with the offset of each record."""
        place = F.row_number().over(Window.partitionBy("topic_id", "flush_id", "schema_id").orderBy("event_id"))
        seg = self.index.select("topic_id", "flush_id", "schema_id", "start_offset")
        return self.log.join(seg, ["topic_id", "flush_id", "schema_id"]).withColumn("offset", F.col("start_offset") + place - 1)

    @cached_property
    def now_us(self) -> DataFrame:
        """One row: the last ingest time, which stands for now."""
        return self.log.agg(F.max("ts_us").alias("now_us"))

    @cached_property
    def dispatched(self) -> DataFrame:
        """index, with the end hw of the topic, of the segments before the dispatch cursor."""
        hw = self.index.groupBy("topic_id").agg(F.max("end_offset").alias("hw"))
        return self.index.join(hw, "topic_id").where("end_offset * 4 <= hw * 3")

    @cached_property
    def cursors(self) -> DataFrame:
        """group_id, topic_id, dispatch_cursor: of each topic the segments that end in the first three quarters of its offsets are dispatched."""
        done = self.dispatched.groupBy("topic_id").agg(F.max("end_offset").alias("dispatch_cursor"))
        return self.topics.join(done, "topic_id", "left").select(F.lit("g1").alias("group_id"), "topic_id", F.coalesce("dispatch_cursor", F.lit(0)).cast("long").alias("dispatch_cursor"))

    @cached_property
    def inflight(self) -> DataFrame:
        """Leases: all that is dispatched beyond the middle of the topic, spread over three readers; what lies before is committed."""
        seg = self.dispatched.where("start_offset * 2 >= hw")
        reader = F.concat(F.lit("r"), (F.col("flush_id") % 3).cast("string"))
        return seg.select(F.lit("g1").alias("group_id"), "topic_id", "start_offset", "end_offset", reader.alias("reader_id"), (F.col("ingest_us") + LEASE_US).alias("expires_us"))

    @cached_property
    def members(self) -> DataFrame:
        """group_id, reader_id, heartbeat_us: the last event of each third of the users; r2 stopped 31 s before."""
        r = self.log.groupBy((F.col("writer_id") % 3).alias("r")).agg(F.max("ts_us").alias("last"))
        last = F.when(F.col("r") == 2, F.col("last") - 31_000_000).otherwise(F.col("last"))
        return r.select(F.lit("g1").alias("group_id"), F.concat(F.lit("r"), F.col("r").cast("string")).alias("reader_id"), last.alias("heartbeat_us"))

    @cached_property
    def claims(self) -> DataFrame:
        """Sink claims: a third of the flushes completed, a third pending, claimed when ingested."""
        status = F.when(F.col("flush_id") % 3 == 0, "completed").otherwise("pending")
        return self.index.where("flush_id % 3 < 2").select("batch_id", status.alias("status"), F.col("ingest_us").alias("claimed_us"))
