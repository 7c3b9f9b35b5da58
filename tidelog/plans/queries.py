"""The registered queries: each applies one operator to the log model of a folder of tables."""

from __future__ import annotations

import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import scalar
from tidelog.operators import append, catalog, groups, groupstate, invariants, pressure, quantiles, readpath, sink, tablesink
from tidelog.operators.registry import Registry, RegistryError
from tidelog.operators.tables import cut, shared_folder
from tidelog.plans.logmodel import LEASE_US, MAX_INFLIGHT, SESSION_US, LogModel
from tidelog.sources import avro, seglog

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(LogModel(spark, sf_dir))
    return f


def rows(m: LogModel, schema: str, *data: tuple) -> DataFrame:
    """Literal rows, as a catalogue would hold them."""
    return m.spark.createDataFrame(list(data), schema)


# append path


@query
def offset_allocation(m):
    return m.index.select("topic_id", "flush_id", "schema_id", "start_offset", "end_offset", "record_count")


@query
def segment_index(m):
    return m.index.drop("batch_id")


@query
def segment_layout(m):
    """Objects: one per flush; where each segment lies in it, and the object's bytes."""
    size = F.sum("byte_length").over(Window.partitionBy("flush_id")).cast("long")
    key = scalar.object_key("log", F.col("ingest_us"), F.col("flush_id"))
    return m.index.select("flush_id", "topic_id", "schema_id", "byte_offset", (F.col("byte_offset") + F.col("byte_length")).alias("byte_end"), size.alias("object_bytes"), key.alias("object_key"))


@query
def record_encoded_size(m):
    return m.log.select("event_id", "size", scalar.encoded_size(F.col("key"), F.col("value")).alias("encoded_size"))


@query
def segment_crc(m):
    """One row per segment: segment_crc over all its encoded records in offset order, and its first record's offset and value's
    crc (no twin in the checking SQL). A segment is within a flush, so it has at most 64 records."""
    encoded = F.udf(lambda rs: zlib.crc32(seglog.encode_records((None if r["key"] is None else r["key"].encode(), (r["value"] or "").encode()) for r in rs)), "long")
    segs = m.records.groupBy("topic_id", "flush_id", "schema_id").agg(F.sort_array(F.collect_list(F.struct("offset", "key", "value"))).alias("rs"))
    return segs.select("topic_id", F.col("rs")[0]["offset"].alias("offset"), F.crc32(F.col("rs")[0]["value"]).alias("crc"), encoded("rs").alias("segment_crc"))


@query
def buffer_merge(m):
    return append.merged(m.log)


@query
def ack_distribution(m):
    return append.acks(m.requests, m.index)


@query
def dedup_coalesce(m):
    return append.coalesced(m.arrivals)


@query
def dedup_classify(m):
    return append.classified(m.arrivals)


@query
def dedup_pipelined(m):
    return append.classified(m.arrivals, pipelined=True)


@query
def writer_state_upsert(m):
    """State after flush 50, then everything later."""
    old = append.writer_state(rows(m, "writer_id long, last_seq long"), m.requests.where("flush_id <= 50"))
    return append.writer_state(old, m.requests.where("flush_id > 50"))


@query
def writer_acks(m):
    """The stored acknowledgement of each writer: state after flush 50, then everything later."""
    acked = append.acks(m.requests, m.index).join(m.requests.select("writer_id", "append_seq", "flush_id"), ["writer_id", "append_seq"])
    old = append.writer_acks(rows(m, "writer_id long, last_seq long, last_start long, last_end long"), acked.where("flush_id <= 50"))
    return append.writer_acks(old, acked.where("flush_id > 50"))


@query
def dedup_answers(m):
    """Retries against the stored state: the last request of a writer is answered with its acknowledgement."""
    state = append.writer_acks(rows(m, "writer_id long, last_seq long, last_start long, last_end long"), append.acks(m.requests, m.index))
    return append.answered(m.arrivals, state)


@query
def ack_ranges(m):
    """Requests of several records: those of a writer in a segment are one request, numbered by flush."""
    first = m.log.groupBy("flush_id", "topic_id", "schema_id", "writer_id").agg(F.min("event_id").alias("event_id"), F.count("*").alias("record_count"))
    return append.acks(first.withColumn("append_seq", F.col("event_id")), m.index)


@query
def append_bytes(m):
    return append.bytes_by_writer(m.log)


@query
def accepted_offsets(m):
    """Dedup, then offsets over accepted requests only: per topic and flush."""
    ok = append.classified(m.arrivals).where("decision = 'ACCEPT'").select("arrival")
    log = m.arrivals.join(ok, "arrival").select("topic_id", "flush_id", "schema_id", F.lit(1).alias("size"), F.col("at").alias("ts_us"))
    return append.segments(log).select("topic_id", "flush_id", "schema_id", "start_offset", "end_offset")


# read path


@query
def segment_lookup(m):
    return readpath.lookup(m.index, 250)


@query
def segment_lookup_bounded(m):
    return readpath.lookup(m.index, 250, 400)


@query
def offset_point_lookup(m):
    return readpath.point_lookup(m.index, [0, 250, 999])


@query
def high_watermark(m):
    return readpath.high_watermark(m.topics.unionByName(rows(m, "topic_id long, topic string", (99, "empty"))), m.index)


@query
def read_from_offset(m):
    return readpath.from_offset(m.records, 100)


@query
def read_range(m):
    return readpath.from_offset(m.records, 100, 200)


@query
def read_beyond_watermark(m):
    return readpath.from_offset(m.records, 1_000_000_000)


@query
def read_max_bytes(m):
    return readpath.within_budget(m.records, 100, 4096)


@query
def schema_runs(m):
    return readpath.schema_runs(m.index, m.topics.unionByName(rows(m, "topic_id long, topic string", (99, "empty"))))


@query
def flagship(m):
    """Read topic `purchase` from offset 50 with a byte budget; report its schema runs and the high watermark."""
    topic = m.topics.where("topic = 'purchase'").select("topic_id")
    got = readpath.within_budget(m.records.join(topic, "topic_id", "left_semi"), 50, 16_384).select("topic_id", "offset")
    recs = m.records.select("topic_id", "offset", "schema_id").join(got, ["topic_id", "offset"])
    segs = recs.select("topic_id", "schema_id", F.col("offset").alias("start_offset"), (F.col("offset") + 1).alias("end_offset"), F.lit(1).cast("long").alias("record_count"))
    return readpath.schema_runs(segs, topic).drop("high_watermark").join(readpath.high_watermark(m.topics, m.index), "topic_id")


@query
def tail_last_n(m):
    return readpath.tail(m.records, 100)


@query
def tail_json(m):
    """Every record as a row of the JSON tail: offset, key, value."""
    return m.records.select("topic_id", "offset", "key", "value", F.get_json_object(F.to_json(F.struct("offset", "key", "value")), "$.value").alias("json_value"))


@query
def tail_decode_fallback(m):
    broken = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), "value")).otherwise(F.col("value"))
    return readpath.display(m.records.withColumn("value", broken))


@query
def json_ingest(m):
    """JSON values against a schema of one long field k: accepted with its value or default, or rejected for an unknown field."""
    v = F.when(F.col("event_id") % 13 == 0, F.lit('{"z": 1}')).when(F.col("event_id") % 17 == 0, F.lit("{}")).otherwise(F.col("props"))
    schema = '{"type":"record","name":"K","fields":[{"name":"k","type":"long","default":-1}]}'
    coded = avro.ingested(m.table("events").select("event_id", v.alias("j")), "j", schema)
    return avro.decode_column(coded, "datum", schema).select("event_id", F.when(F.col("status") == "OK", "OK").otherwise("REJECTED").alias("status"), "k")


# joins and catalogue


def topic_schemas(m):
    """Schemas 100..102 of each topic, created by first use."""
    return m.log.groupBy("topic_id", "schema_id").agg(F.min("ts_us").alias("created_us"))


@query
def latest_schema_per_topic(m):
    return catalog.latest_schema(topic_schemas(m))


@query
def schemas_for_topic(m):
    return topic_schemas(m).where("topic_id = 1").select("topic_id", "schema_id", "created_us")


@query
def cursor_vs_watermark(m):
    return groups.cursor_lag(m.cursors, readpath.high_watermark(m.topics, m.index))


@query
def unclaimed_batches(m):
    return sink.unclaimed(m.index, m.claims, [1, 2, 3], 100)


@query
def member_exists(m):
    """Leases whose reader is a live member (semi join)."""
    return m.inflight.join(m.members.where("reader_id <> 'r1'"), ["group_id", "reader_id"], "left_semi").select("topic_id", "start_offset", "reader_id")


@query
def topics_in_list(m):
    return m.index.where(F.col("topic_id").isin(1, 3)).select("topic_id", "flush_id", "schema_id")


@query
def group_member_counts(m):
    gs = m.topics.select(F.lit("g1").alias("group_id"), "topic_id").unionByName(m.topics.select(F.lit("g2").alias("group_id"), "topic_id"))
    return groups.member_counts(gs, m.members)


@query
def topic_resolution(m):
    return catalog.resolved(rows(m, "ref string", ("purchase",), ("2",), ("5",), ("77",), ("nothing",)), m.topics)


@query
def list_topics(m):
    return catalog.newest(m.log.groupBy("topic_id", "topic").agg(F.min("ts_us").alias("created_us")), "created_us", "topic_id", 100)


@query
def list_groups(m):
    return m.cursors.select("group_id", "topic_id", "dispatch_cursor").orderBy("group_id", "topic_id")


@query
def topic_update(m):
    old = m.topics.withColumn("retention_hours", F.lit(168).cast("long"))
    return catalog.updated(old, rows(m, "topic_id long, retention_hours long", (1, 24), (2, None), (88, 1)))


@query
def retention_prune(m):
    keep = m.topics.withColumn("retention_hours", F.col("topic_id") * 24)
    return catalog.expired_segments(m.index, keep, m.now_us)


@query
def stale_writers(m):
    return catalog.stale_writers(m.log, m.now_us, 86_400_000_000)


# reader groups


@query
def group_join(m):
    new = m.members.where("reader_id <> 'r0'").select("group_id", "reader_id", (F.col("heartbeat_us") + 5_000_000).alias("heartbeat_us"))
    return groups.joined(m.members, new.unionByName(rows(m, "group_id string, reader_id string, heartbeat_us long", ("g1", "r9", 1))))


@query
def inflight_per_reader(m):
    return groups.inflight_per_reader(m.inflight, MAX_INFLIGHT)


@query
def poll_next_range(m):
    return groups.poll_next(m.index, 120, 4096)


@query
def poll_sequence(m):
    return groups.poll_sequence(m.index, 4096)


@query
def expired_lease_steal(m):
    return groups.expired_lease(m.inflight, m.now_us)


@query
def heartbeat_renew(m):
    return groups.renewed(m.inflight, "r1", m.now_us, LEASE_US)


@query
def committed_watermark(m):
    return groups.committed_watermark(m.cursors, m.inflight.where("topic_id <> 2"))


@query
def cursor_rollback(m):
    return groups.cursor_rollback(m.cursors, m.inflight.where("reader_id = 'r2' AND topic_id <> 3"))


@query
def expired_members(m):
    return groups.expired_members(m.members, m.now_us, SESSION_US)


@query
def group_leave(m):
    return groups.after_leave(m.cursors, m.inflight, F.col("reader_id") == "r0")


@query
def force_reset(m):
    return groups.force_reset(m.cursors, m.inflight)


@query
def force_remove_member(m):
    """Our semantics: the cursor rolls back, so the watermark can't pass what the member had not committed."""
    return groups.after_leave(m.cursors, m.inflight, F.col("reader_id") == "r2")


@query
def commit_ownership(m):
    """Every lease committed by its reader, but by r0 where the end of the range is divisible by 4."""
    asked = m.inflight.withColumn("reader_id", F.when(F.col("end_offset") % 4 == 0, "r0").otherwise(F.col("reader_id"))).drop("expires_us")
    return groups.commits(m.inflight, asked)


# reader groups as steps of a state; each query shows the state, or the answers, after one step


def group_state(m):
    return groupstate.State(m.members, m.inflight, m.cursors)


def cut_state(m):
    """The state as tables of its own, as a service would hold it."""
    return groupstate.State(cut(m.members), cut(m.inflight), cut(m.cursors))


def at_last(m) -> int:
    return m.now_us.first()["now_us"] or 0


def readers(m, *names: str) -> DataFrame:
    return rows(m, "group_id string, reader_id string", *(("g1", n) for n in names))


@query
def group_join_state(m):
    """r9 joins g1, and a new group g2."""
    new = m.topics.select(F.explode(F.array(F.lit("g1"), F.lit("g2"))).alias("group_id"), "topic_id", F.lit("r9").alias("reader_id"))
    return groupstate.join(group_state(m), new, at_last(m)).summary()


@query
def poll_decision(m):
    """A poll for each topic where no lease has expired, where all may have, and with a limit of ten leases; topic 1 is asked for by no member."""
    reader = F.when(F.col("topic_id") == 1, "r9").otherwise(F.concat(F.lit("r"), (F.col("topic_id") % 3).cast("string")))
    asked = m.topics.select(F.lit("g1").alias("group_id"), "topic_id", reader.alias("reader_id"))
    state, index, out = cut_state(m), cut(m.index), None
    for name, now, most in (("fresh", 0, 1 << 30), ("steal", at_last(m), 1 << 30), ("limited", at_last(m), MAX_INFLIGHT)):
        _, answer = groupstate.poll(state, index, asked, now, 4096, LEASE_US, most)
        answer = answer.withColumn("scenario", F.lit(name))
        out = answer if out is None else out.unionByName(answer)
    return out.drop("group_id")


@query
def poll_state(m):
    """The state after a fresh poll by r0 for each topic."""
    asked = m.topics.select(F.lit("g1").alias("group_id"), "topic_id", F.lit("r0").alias("reader_id"))
    return groupstate.poll(cut_state(m), cut(m.index), asked, 0, 4096, LEASE_US, 1 << 30)[0].summary()


@query
def poll_after_leave(m):
    """r0 leaves, r1 polls: what is dealt out again ends where a lease of another reader begins."""
    asked = m.topics.select(F.lit("g1").alias("group_id"), "topic_id", F.lit("r1").alias("reader_id"))
    return groupstate.poll(groupstate.leave(cut_state(m), readers(m, "r0")), cut(m.index), asked, 0, 1 << 40, LEASE_US, 1 << 30)[1].drop("group_id")


@query
def heartbeat_state(m):
    """r1 is heard of: members silent for too long go."""
    return groupstate.heartbeat(group_state(m), readers(m, "r1"), at_last(m), LEASE_US, SESSION_US)[0].summary()


@query
def heartbeat_answers(m):
    return groupstate.heartbeat(group_state(m), readers(m, "r1", "r9"), at_last(m), LEASE_US, SESSION_US)[1]


@query
def commit_state(m):
    """Every lease is committed by r0: those of others stay."""
    asked = m.inflight.drop("expires_us").withColumn("reader_id", F.lit("r0"))
    return groupstate.commit(group_state(m), asked)[0].summary()


@query
def leave_state(m):
    return groupstate.leave(group_state(m), readers(m, "r0")).summary()


@query
def force_remove_state(m):
    return groupstate.leave(group_state(m), readers(m, "r2")).summary()


@query
def force_reset_state(m):
    """Topics 1 and 2 are reset: their leases and all members of the group go."""
    return groupstate.force_reset(group_state(m), rows(m, "group_id string, topic_id long", ("g1", 1), ("g1", 2))).summary()


# sink, claims, evolution


@query
def claims_upsert(m):
    return sink.claimed(m.claims, m.index.where("flush_id % 2 = 0"))


@query
def stale_claims(m):
    return sink.stale_claims(m.claims, m.now_us, 300_000_000)


@query
def catchup_grouping(m):
    return sink.catchup_groups(m.index.join(m.claims, "batch_id", "left_anti"))


@query
def sink_flush_victim(m):
    return sink.flush_victims(m.index, 100_000)


def decoded(m):
    """Orders as decoded records of two writer schemas: version 1 with the total as float and no priority, version 2 with all."""
    o = sink.with_metadata(m.table("orders"), F.col("o_orderkey"), F.lit(1), scalar.micros(F.col("o_orderdate")), F.col("o_custkey").cast("string"))
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("int").alias("order_id"), F.col("o_totalprice").cast("float").alias("total"), F.col("o_orderstatus").alias("state"), *sink.META)
    new = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), *sink.META)
    return old, new


@query
def sink_projection(m):
    """Widening int>long and float>double, renaming state>status by the reader's hint, a default for the priority."""
    old, new = decoded(m)
    a = sink.projected(old, [("order_id", "bigint", "order_id", None), ("total", "double", "total", None), ("status", "string", "state", None), ("priority", "string", None, F.lit("unknown"))])
    b = sink.projected(new, [(c, t, c, None) for c, t in (("order_id", "bigint"), ("total", "double"), ("status", "string"), ("priority", "string"))])
    return a.unionByName(b)


PARCEL_1 = '{"type":"record","name":"P","fields":[{"name":"order_id","type":"int"},{"name":"total","type":"float"},{"name":"state","type":"string"}]}'
PARCEL_2 = '{"type":"record","name":"P","fields":[{"name":"order_id","type":"long"},{"name":"total","type":"double"},{"name":"status","type":"string","aliases":["state"]},{"name":"priority","type":["null","string"],"default":"unknown"}]}'


def sunk(m):
    """Orders written as Avro to segment files under two schemas, and taken into a table by the catch-up job; a second run adds nothing."""
    seglog.register(m.spark)
    folder = f"{shared_folder(m.spark).rstrip('/')}/sink-{uuid.uuid4().hex}"
    old, new = decoded(m)
    for number, schema, part in ((100, PARCEL_1, old), (101, PARCEL_2, new)):
        coded = avro.encode_column(part, schema, "datum").select(F.lit(1).cast("long").alias("topic_id"), F.lit(number).cast("long").alias("schema_id"), F.col("_ingest_time").alias("ingest_us"), F.col("_key").cast("binary").alias("key"), F.col("datum").alias("value"))
        coded.write.format("seglog").mode("append").save(f"{folder}/log")
    table, claims = tablesink.SinkTable(m.spark, f"{folder}/table"), tablesink.Claims(f"{folder}/claims")
    table.ensure("parcels", PARCEL_2)
    for _ in range(2):
        tablesink.catch_up(m.spark, f"{folder}/log", {1: table}, {100: PARCEL_1, 101: PARCEL_2}, claims, lambda: 0)
    return table.read()


@query
def sink_write_segments(m):
    """What the table holds after segments of two writer schemas were taken in."""
    return sunk(m).select("order_id", "total", "status", "priority", "_partition_id", F.col("_key").cast("string").alias("_key"))


@query
def sink_offsets(m):
    """The offsets in the table are gap-free: how many, the least, the largest, how many different ones."""
    return sunk(m).groupBy("_partition_id").agg(F.count("*").alias("n"), F.min("_offset").alias("low"), F.max("_offset").alias("high"), F.countDistinct("_offset").alias("n_offsets"))


@query
def segment_roundtrip(m):
    """Every record of the log written to segment files and read back, check values compared."""
    seglog.register(m.spark)
    path = f"{shared_folder(m.spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    m.records.select("topic_id", "schema_id", F.col("ts_us").alias("ingest_us"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")).write.format("seglog").mode("append").save(path)
    back = m.spark.read.format("seglog").load(path)
    return back.select("topic_id", "schema_id", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query
def registry_schemas(m):
    """Schemas of two versions registered for every topic: equal content shares an id, an unreadable version is refused."""
    registry = Registry(f"{shared_folder(m.spark).rstrip('/')}/registry-{uuid.uuid4().hex}")
    for r in m.topics.orderBy("topic_id").collect():  # a catalogue
        topic = registry.create_topic(r["topic"])
        for at, schema in enumerate((PARCEL_1, PARCEL_2, PARCEL_2, PARCEL_1)):
            try:
                registry.register(topic, schema, at)
            except RegistryError:
                pass
    return registry.table(m.spark).select("topic_id", "schema_id", "created_us")


@query
def sink_metadata_columns(m):
    return m.records.select("value", F.col("offset").alias("_offset"), F.col("topic_id").cast("int").alias("_partition_id"), F.col("ts_us").alias("_ingest_time"), F.col("key").alias("_key"))


FIELDS = "table_name string, column_name string, type string"


@query
def schema_diff(m):
    old = rows(m, FIELDS, ("t", "old_id", "int"), ("t", "removed", "string"), ("t", "kept", "long"), ("o", "amount", "float"), ("o", "lost", "string"))
    new = rows(m, FIELDS, ("t", "new_id", "long"), ("t", "added", "string"), ("t", "kept", "long"), ("o", "amount", "double"), ("o", "extra", "int"))
    return sink.schema_diff(old, new, rows(m, "table_name string, old_name string, new_name string", ("t", "old_id", "new_id")), rows(m, "table_name string, column_name string", ("t", "removed")))


@query
def schema_hash(m):
    return m.table("events").select("event_id", F.sha2("props", 256).alias("hash"))


@query
def schema_register(m):
    """Every event's payload text as a schema of its topic: ids from 100 by first sight, equal text shares an id."""
    return catalog.numbered_schemas(m.log.select("topic_id", F.col("value").alias("schema_json"), F.col("event_id").alias("at")))


@query
def enum_compat(m):
    """Whether all symbols that a topic used in the first half also occur in the second (writer's symbols within the reader's)."""
    half = m.log.agg(F.max("event_id").alias("last"))  # one row
    s = m.log.crossJoin(F.broadcast(half)).select("topic_id", "schema_id", F.expr("event_id * 2 < last").alias("old")).groupBy("topic_id").agg(F.collect_set(F.when(F.col("old"), F.col("schema_id"))).alias("w"), F.collect_set(F.when(~F.col("old"), F.col("schema_id"))).alias("r"))
    return s.select("topic_id", (F.size(F.array_except("w", "r")) == 0).alias("compatible"))


@query
def sink_nested_orders(m):
    """Orders with their lines as an array of structs, unnested again to totals: what a nested record column must carry."""
    lines = m.table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    n = F.aggregate("lines", F.lit(0.0).cast("double"), lambda a, x: a + x["l_quantity"])
    return lines.select("l_orderkey", F.size("lines").cast("long").alias("n_lines"), n.alias("quantity"))


ORDER = '{"type":"record","name":"Order","fields":[{"name":"o_orderkey","type":"long"},{"name":"o_orderstatus","type":["null","string"]},{"name":"o_totalprice","type":"double"}]}'


@query
def avro_roundtrip(m):
    """Orders as Avro datums and back."""
    coded = avro.encode_column(m.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ORDER, "datum").select("datum")
    return avro.decode_column(coded, "datum", ORDER).drop("datum")


@query
def schema_fingerprint(m):
    """Content hash of each event's payload text, taken as a schema: canonical JSON, sha256."""

    @F.pandas_udf("string")
    def fingerprint(s: pd.Series) -> pd.Series:
        return s.map(avro.schema_hash)

    return m.table("events").select("event_id", fingerprint("props").alias("hash"))


@query
def schema_compat_matrix(m):
    """Which of three versions of a record can read which: v2 widens a number, v3 adds a nullable field."""

    def user(age, *more):
        return {"type": "record", "name": "User", "fields": [{"name": "user_id", "type": "string"}, {"name": "age", "type": age}, *more]}

    versions = [user("int"), user("long"), user("long", {"name": "email", "type": ["null", "string"], "default": None})]
    pairs = [(i + 1, j + 1, avro.compatible(new, old)) for i, new in enumerate(versions) for j, old in enumerate(versions)]
    return rows(m, "new_version long, old_version long, compatible boolean", *pairs)


# buffers


@query
def flush_due(m):
    """What each topic has buffered of the last flushes, and whether size or age makes it due."""
    buffers = m.log.groupBy("topic_id").agg(F.sum("size").alias("bytes"), F.min("ts_us").alias("oldest_us"))
    return pressure.flush_due(buffers, m.now_us, 40_000, 60_000_000)


@query
def backpressure(m):
    """Levels of each topic's buffer: its segments come in, every fourth flush takes most of it out."""
    seg = m.index.withColumn("bytes", F.expr("byte_length * (flush_id % 11)")).withColumn("flushed", F.expr("flush_id % 4 = 0"))
    rows = seg.select("topic_id", F.expr("flush_id * 10 + schema_id - 100").alias("step"), "bytes", "flushed")
    return pressure.backpressure(rows, 1_500, 400, "topic_id")


@query
def writer_evictions(m):
    first = m.log.groupBy("writer_id").agg(F.min("event_id").alias("inserted"))
    return pressure.evicted(first, 10)


@query
def latest_schema_text(m):
    schemas = topic_schemas(m).select("schema_id", F.concat(F.lit("version "), F.col("schema_id").cast("string")).alias("schema_json")).distinct()
    return catalog.latest_schema_text(topic_schemas(m), schemas)


@query
def group_detail(m):
    return groups.detail(m.members, m.inflight)


@query
def index_by_day(m):
    return catalog.by_day(m.index).groupBy("ingest_date").agg(F.count("*").alias("n"), F.sum("byte_length").alias("bytes"))


@query
def tail_avro(m):
    """Orders as Avro datums shown as JSON; every tenth is broken and shown as it is."""
    o = m.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    coded = avro.encode_column(o, ORDER, "datum").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.lit("?").cast("binary")).otherwise(F.col("datum")).alias("datum"))
    shown = avro.displayed(coded.withColumnRenamed("o_orderkey", "at"), "datum", ORDER)
    return shown.select("at", F.get_json_object("display", "$.o_orderstatus").alias("status"), (F.col("display") == "?").alias("broken"))


# access control


@query
def acl_upsert(m):
    """Every named entry is created again, with the other permission."""
    acls = acl_tables(m)[1]
    return catalog.acl_upsert(acls, acls.where("resource_name <> '*'").withColumn("permission", F.when(F.col("permission") == "deny", "allow").otherwise("deny")))


@query
def acl_delete(m):
    return catalog.acl_delete(acl_tables(m)[1], principal="user:building", operation="append")[0]


@query
def api_key_lookup(m):
    c = m.table("customer").select("c_custkey", F.md5("c_name").alias("h"))
    presented = c.select(F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("bad_"), "h")).otherwise(F.concat(F.lit("tb_"), "h", F.lit("_secret"))).alias("api_key"))
    keys = c.where("c_custkey % 3 > 0").select(F.col("h").alias("key_id"), F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("principal"), (F.col("c_custkey") % 5 * 100).alias("expires_us"), F.when(F.col("c_custkey") % 7 == 0, F.lit(5).cast("long")).alias("revoked_us"))
    return catalog.keys_validated(presented, keys, 200)


def acl_tables(m):
    seg = m.table("customer").select(F.col("c_custkey"), F.concat(F.lit("user:"), F.lower("c_mktsegment")).alias("principal"), F.col("c_nationkey"))
    nation = m.table("nation").select(F.col("n_nationkey"), F.col("n_name"))
    pairs = seg.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("principal", "n_name", "n_nationkey").distinct()
    named = pairs.where("n_nationkey % 3 = 0").select("principal", F.lit("topic").alias("resource_type"), F.col("n_name").alias("resource_name"), F.when(F.col("n_nationkey") % 2 == 0, "append").otherwise("*").alias("operation"), F.when(F.col("n_nationkey") % 4 == 0, "deny").otherwise("allow").alias("permission"))
    wild = pairs.select("principal").distinct().select("principal", F.lit("topic").alias("resource_type"), F.lit("*").alias("resource_name"), F.when(F.length("principal") % 2 == 0, "consume").otherwise("append").alias("operation"), F.when(F.length("principal") % 3 == 0, "deny").otherwise("allow").alias("permission"))
    asks = pairs.select("principal", F.lit("topic").alias("resource_type"), F.col("n_name").alias("resource_name"), F.explode(F.array(F.lit("append"), F.lit("consume"))).alias("operation"))
    admin = rows(m, "principal string, resource_type string, resource_name string, operation string", ("admin", "topic", "FRANCE", "append"), ("admin:ops", "group", "g1", "consume"), ("user:none", "topic", "x", "append"))
    return asks.unionByName(admin), named.unionByName(wild)


@query
def acl_decision(m):
    return catalog.acl_decision(*acl_tables(m))


@query
def acl_list(m):
    return acl_tables(m)[1].where("permission = 'deny' AND resource_type = 'topic'").select("principal", "resource_name", "operation")


@query
def request_authz(m):
    asks, acls = acl_tables(m)
    return catalog.request_authz(asks.withColumn("request_id", F.concat_ws("/", "principal", "operation")), acls)


@query
def api_key_status(m):
    h = F.substring(F.md5(F.col("c_name")), 1, 32)
    k = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("bad_"), h)).otherwise(F.concat(F.lit("tb_"), h, F.lit("_secret")))
    return catalog.key_status(m.table("customer").select(k.alias("api_key"), (F.col("c_custkey") % 7 == 0).alias("revoked"), (F.col("c_custkey") % 5 * 100).alias("expires_us"), F.lit(200).alias("now_us")))


@query
def principal_parse(m):
    names = m.table("customer").select(F.concat(F.lit("user:"), "c_mktsegment").alias("principal")).distinct()
    return catalog.principals(names.unionByName(rows(m, "principal string", ("admin",), ("admin:x",), ("service:a:b",), ("plain",))))


@query
def error_codes(m):
    data = [("service", k, v, k in scalar.RETRYABLE) for k, v in scalar.ERROR_CODES.items()] + [("wire", k, v, False) for k, v in scalar.WIRE_CODES.items()]
    return rows(m, "family string, code long, name string, retryable boolean", *data)


@query
def latency_quantiles(m):
    q = quantiles.discrete(m.table("events"), "event_type", "value", {"p50": 500, "p99": 990, "p999": 999})
    return q.select("event_type", "n", *(F.round(p, 6).alias(p) for p in ("p50", "p99", "p999")))


# history invariants: the correct history of the log, or one with faults (broken)


def history(m, broken: bool = False):
    """writes and seen values of the log; broken: some offsets doubled or swapped, some values repeated, lost or invented."""
    v = F.concat(F.lit("p"), F.col("writer_id").cast("string"), F.lit("-s"), F.col("append_seq").cast("string"))
    r = m.records.join(m.requests.select("event_id", "append_seq"), "event_id")
    w = r.select("writer_id", "topic_id", "append_seq", "offset", v.alias("value"), (F.col("event_id") * 1000).alias("start_us"), (F.col("event_id") * 1000 + 500).alias("end_us"), F.lit(True).alias("success"))
    s = w.select("topic_id", "value", "offset")
    if broken:
        w = w.withColumn("offset", F.when(F.col("offset") % 97 == 5, F.col("offset") + 1).when(F.col("offset") % 89 == 7, F.col("offset") + 20).otherwise(F.col("offset")))
        w = w.withColumn("value", F.when(F.col("append_seq") % 31 == 3, F.concat(F.lit("p"), F.col("writer_id").cast("string"), F.lit("-s1"))).otherwise(F.col("value")))
        s = s.where("offset % 83 <> 2")
    return w, s


def reads(m, broken: bool = False):
    """Reads of 50 offsets in turn by a reader per topic; broken: some start off, some report a lower watermark."""
    n = m.index.groupBy("topic_id").agg(F.max("end_offset").alias("n"))
    r = n.select("topic_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("greatest(n - 1, 0) div 50"))).alias("read_no"), "n")
    at, hw = F.col("read_no") * 50, F.least(F.col("read_no") * 60 + 60, "n")
    if broken:
        at, hw = at + F.when(F.col("read_no") % 7 == 3, 1).otherwise(0), hw - F.when(F.col("read_no") % 5 == 4, 100).otherwise(0)
    return r.select(F.lit("r0").alias("reader_id"), "topic_id", "read_no", at.alias("requested_offset"), F.least(F.lit(50).cast("long"), F.col("n") - F.col("read_no") * 50).alias("n_values"), hw.alias("high_watermark"))


def frontier(m):
    """The latest read began after three quarters of the writes."""
    last = m.log.agg((F.max("event_id") * 750).alias("last_read_us"))  # one row
    return readpath.high_watermark(m.topics, m.index).crossJoin(F.broadcast(last))


for _name, _f in {
    "inv_visible": lambda m, b: invariants.not_visible(*history(m, b), frontier(m)),
    "inv_unique_offsets": lambda m, b: invariants.repeated_offsets(history(m, b)[0]),
    "inv_watermark_monotonic": lambda m, b: invariants.falling_watermarks(reads(m, b)),
    "inv_no_duplicates": lambda m, b: invariants.repeated_values(history(m, b)[0]),
    "inv_poll_contiguity": lambda m, b: invariants.gaps_between_polls(reads(m, b)),
    "inv_causal": lambda m, b: invariants.acausal(history(m, b)[0]),
    "inv_monotonic_sends": lambda m, b: invariants.falling_sends(history(m, b)[0]),
    "inv_no_phantom": lambda m, b: invariants.phantoms(history(m)[1], history(m, b)[0]),
}.items():
    QUERIES[_name] = lambda spark, sf_dir, f=_f: f(LogModel(spark, sf_dir), False)
    QUERIES[_name + "_broken"] = lambda spark, sf_dir, f=_f: f(LogModel(spark, sf_dir), True)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
