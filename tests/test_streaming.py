"""Streams give what batches give."""

import time

from tidelog.operators.append import classified
from tidelog.plans.logmodel import LogModel
from tidelog.streaming.dedup import committed, dedup_stream, idempotent_sink


def test_dedup_stream_equals_batch(spark, sf, tmp_path):
    arrivals = LogModel(spark, sf).arrivals.select("arrival", "writer_id", "append_seq", "flush_id").where("writer_id < 6")
    for k, part in enumerate(("arrival < 2000", "arrival >= 2000")):
        arrivals.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{k}"))
    stream = spark.readStream.schema(arrivals.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = dedup_stream(stream).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(idempotent_sink(str(tmp_path / "out"), lambda df: df)).start()
    q.awaitTermination()
    got = {tuple(r)[:4] for r in committed(spark, str(tmp_path / "out")).select("arrival", "writer_id", "append_seq", "decision").collect()}
    assert got == {tuple(r) for r in classified(arrivals).collect()}


def test_sink_is_idempotent_and_ignores_unfinished_batches(spark, tmp_path):
    write = idempotent_sink(str(tmp_path / "t"))
    df = spark.range(5)
    write(df, 0)
    write(df, 0)
    write(df, 1)
    write(df, 2)
    (tmp_path / "t/batch=2/_SUCCESS").unlink()
    assert committed(spark, str(tmp_path / "t")).count() == 10


COMMANDS = "group_id string, topic_id long, at_us long, seq long, kind string, reader_id string, start_offset long, end_offset long, bytes long"


def command_rows():
    """Two groups on a topic of 40 segments: two readers poll in turn, one falls silent, the other goes on, leases expire."""
    out = [(g, 1, 0, k, "segment", "", 10 * k, 10 * k + 10, 100) for g in ("a", "b") for k in range(40)]
    at = 1
    for g in ("a", "b"):
        out += [(g, 1, 1, 100, "join", "x", None, None, None), (g, 1, 1, 101, "join", "y", None, None, None)]
    for k in range(6):
        at += 20
        for g in ("a", "b"):
            who = "xy"[k % 2] if k < 2 else "x"
            out += [(g, 1, at, 200 + 10 * k, "poll", who, None, None, 250), (g, 1, at, 201 + 10 * k, "heartbeat", who, None, None, None), *([(g, 1, at, 202, "poll", "z", None, None, 250), (g, 1, at, 203, "heartbeat", "z", None, None, None)] if k == 0 else [])]
            if g == "a" and k == 0:
                out.append((g, 1, at, 205 + 10 * k, "commit", who, 30 * k, 30 * k + 30, None))
    out.append(("a", 1, at + 5, 900, "leave", "x", None, None, None))
    return out


def plain_steps(spark, commands):
    """The answers by operators.groupstate, command by command."""
    from tidelog.operators import groupstate as gs

    limits = {"lease_us": 45, "max_inflight": 3}
    frame = lambda schema, *data: spark.createDataFrame(list(data), schema)
    fixed = lambda df, schema: frame(schema, *map(tuple, df.select(*(c.split()[0] for c in schema.split(", "))).collect()))
    schemas = "group_id string, reader_id string, heartbeat_us long", "group_id string, topic_id long, start_offset long, end_offset long, reader_id string, expires_us long", "group_id string, topic_id long, dispatch_cursor long"
    state = gs.State(*(frame(s) for s in schemas))
    index = frame("topic_id long, start_offset long, end_offset long, byte_length long", *((1, r[6], r[7], r[8]) for r in commands if r[4] == "segment")).cache()
    out = {}
    for g, topic, at, seq, kind, reader, start, end, size in sorted((r for r in commands if r[4] != "segment"), key=lambda r: (r[2], r[3])):
        one = frame("group_id string, topic_id long, reader_id string, start_offset long, end_offset long", (g, topic, reader, start, end))
        answer = None
        if kind == "join":
            state = gs.join(state, one, at)
        elif kind == "poll":
            state, answer = gs.poll(state, index, one.select("group_id", "topic_id", "reader_id"), at, size, **limits)
        elif kind == "heartbeat":
            state, answer = gs.heartbeat(state, one.select("group_id", "reader_id"), at, 45, 30)
        elif kind == "commit":
            state, answer = gs.commit(state, one)
        else:
            state = gs.leave(state, one)
        got = answer.collect()[0].asDict() if answer is not None else {}
        state = gs.State(*(fixed(df, s) for df, s in zip((state.members, state.leases, state.cursors), schemas)))
        mark = {r["group_id"]: r["committed_watermark"] for r in state.summary().collect()}[g]
        out[g, at, seq] = (got.get("status", "OK"), got.get("start_offset"), got.get("end_offset"), mark)
    return out


def test_coordinator_stream_equals_the_steps(spark, tmp_path):
    from tidelog.streaming.groups import coordinate

    commands = [r for r in command_rows() if r[0] == "a"]
    df = spark.createDataFrame(command_rows(), COMMANDS)
    for k, part in enumerate(("at_us < 50", "at_us >= 50")):  # two micro-batches
        df.where(part).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = coordinate(stream, 45, 30, 3).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(idempotent_sink(str(tmp_path / "out"), lambda df: df)).start()
    q.awaitTermination()
    got = {(r["group_id"], r["at_us"], r["seq"]): (r["status"], r["start_offset"], r["end_offset"], r["committed_watermark"]) for r in committed(spark, str(tmp_path / "out")).collect()}
    want = plain_steps(spark, commands)
    assert {k: v for k, v in got.items() if k[0] == "a"} == want and len(got) > len(want)
    assert {v[0] for v in want.values()} >= {"OK", "MAX_INFLIGHT", "UNKNOWN_MEMBER"} and any(v[1] is not None for v in want.values())


def test_segment_stream_follows_commits(spark, tmp_path):
    from tidelog.sources import seglog

    seglog.register(spark)
    path = str(tmp_path / "log")
    write = lambda k: spark.createDataFrame([(1, 100, 1000 * k, None, f"v{k}-{i}".encode()) for i in range(30)], "topic_id long, schema_id long, ingest_us long, key binary, value binary").repartition(2).write.format("seglog").mode("append").save(path)
    write(1)

    def run():
        stream = spark.readStream.format("seglog").load(path)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(idempotent_sink(str(tmp_path / "out"))).start().awaitTermination()
        return sorted(bytes(r["value"]) for r in committed(spark, str(tmp_path / "out")).collect())

    assert run() == sorted(f"v1-{i}".encode() for i in range(30))
    write(2)
    write(3)
    assert run() == sorted(f"v{k}-{i}".encode() for k in (1, 2, 3) for i in range(30))


def test_catch_up_is_idempotent(spark, tmp_path):
    import json

    from tidelog.operators.tablesink import Claims, SinkTable, catch_up
    from tidelog.sources import avro, seglog

    seglog.register(spark)
    log, schema = str(tmp_path / "log"), '{"type":"record","name":"R","fields":[{"name":"n","type":"long"}]}'
    rows = spark.range(50).selectExpr("1L AS topic_id", "100L AS schema_id", "id AS ingest_us", "CAST(NULL AS BINARY) AS key", "id AS n").repartition(3)
    avro.encode_column(rows, schema, "value").drop("n").write.format("seglog").mode("append").save(log)
    table, claims = SinkTable(spark, str(tmp_path / "table")), Claims(str(tmp_path / "claims"))
    table.ensure("r", schema)
    go = lambda now: catch_up(spark, log, {1: table}, {100: schema}, claims, lambda: now, most=2)
    assert go(10) == 2 and go(20) == 0
    got = table.read().collect()
    assert sorted(r["n"] for r in got) == list(range(50)) and sorted(r["_offset"] for r in got) == list(range(50))
    name, about = next(iter(claims.all().items()))
    claims.claim(name, about["batches"], 30)  # a run that died after its commit
    table.store.delete(f"_manifest/{name}.json")  # and one that died before it
    assert go(40) == 0 and table.read().count() < 50 and go(1 << 40) == 1 and table.read().count() == 50
    assert all(c["status"] == "completed" for c in claims.all().values()) and json.dumps(claims.all())


def test_flushes_are_idempotent_and_gap_free(spark, tmp_path):
    from tidelog.streaming.ingest import flushed, flushes

    schema = "topic_id long, flush_id long, schema_id long, event_id long, size long, ts_us long, key string, value string"
    batch = lambda f, n: spark.createDataFrame([(k % 2, f, 100, 100 * f + k, 5, f, None, "v") for k in range(n)], schema)
    write = flushes(str(tmp_path))
    assert flushed(spark, str(tmp_path)).count() == 0
    for b, (f, n) in enumerate(((0, 10), (1, 4), (1, 4), (2, 7))):
        write(batch(f, n), {0: 0, 1: 1, 2: 1, 3: 2}[b])  # batch 1 comes twice
    spark.range(1).write.parquet(str(tmp_path / "records/3"))  # a batch that died before its commit
    got = sorted((r["topic_id"], r["start_offset"], r["end_offset"]) for r in flushed(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 5), (0, 5, 7), (0, 7, 11), (1, 0, 5), (1, 5, 7), (1, 7, 10)] and flushed(spark, str(tmp_path), "records").count() == 21


def test_consume_goes_on_and_metrics_count(spark, tmp_path):
    from tidelog.sources import avro, seglog
    from tidelog.streaming.ingest import Metrics, consume, drain

    seglog.register(spark)
    log, schema, seen, metrics = str(tmp_path / "log"), '{"type":"record","name":"R","fields":[{"name":"n","type":"long"}]}', [], Metrics()
    spark.streams.addListener(metrics)

    def write(low, high):
        rows = spark.range(low, high).selectExpr("id % 2 AS topic_id", "100L AS schema_id", "id AS ingest_us", "CAST(NULL AS BINARY) AS key", "id AS n").repartition(1)
        avro.encode_column(rows, schema, "value").drop("n").write.format("seglog").mode("append").save(log)

    for low in (0, 10):
        write(low, low + 10)
        consume(spark, log, 1, schema, lambda df: seen.extend(r["n"] for r in df.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(seen) == list(range(1, 20, 2))
    q = consume(spark, log, 0, schema, lambda df: seen.extend(r["n"] for r in df.collect()), str(tmp_path / "d"), processingTime="1 second")
    assert drain(q) and sorted(seen) == list(range(20)) and not q.isActive
    spark.streams.removeListener(metrics)
    own = Metrics()
    for ms in (3, 30, 99_999):
        own.observe(5, ms)
    assert 'le="5"} 1' in own.text() and 'le="50"} 2' in own.text() and 'le="+Inf"} 3' in own.text() and "rows_total 15" in own.text()


def test_retries_keep_the_request():
    import pytest

    from tidelog.operators.pressure import PushedBack, retry_delays, with_retries

    slept, got = [], []

    def send(request):
        got.append(request)
        if len(got) < 4:
            raise PushedBack
        return "ok"

    assert with_retries(send, ("w", 7), slept.append) == "ok" and slept == [0.1, 0.2, 0.4] and set(got) == {("w", 7)} and max(retry_delays(12)) == 10
    with pytest.raises(KeyError):
        with_retries({}.__getitem__, 1, slept.append)


def test_dedup_forgets_after_its_time_and_unknown_topics_are_errors(spark, tmp_path):
    import pytest

    from tidelog.operators import append, catalog
    from tidelog.sources import avro

    df = spark.createDataFrame([(1, 1, 5, 0), (2, 1, 5, 0), (3, 2, 1, 0)], "arrival long, writer_id long, append_seq long, flush_id long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    told = []
    q = dedup_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ttl_ms=86_400_000).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda batch, _: told.extend(r["decision"] for r in batch.collect())).start()
    for _ in range(100):  # with a time to live, batches without data follow each other for ever
        if len(told) == 3:
            break
        time.sleep(0.2)
    q.stop()
    assert sorted(told) == ["ACCEPT", "ACCEPT", "DUPLICATE"]
    topics = spark.createDataFrame([(1, "a")], "topic_id long, topic string")
    names = spark.createDataFrame([("a",), ("zz",)], "ref string")
    assert catalog.resolved(names, topics).where("topic_id IS NULL").count() == 1
    with pytest.raises(Exception, match="no topic zz"):
        catalog.resolved(names, topics, strict=True).collect()
    state = spark.createDataFrame([(1, 9, 0, 1, True)], "writer_id long, last_seq long, last_start long, last_end long, failed boolean")
    assert {o: [r["decision"] for r in append.answered(df.where("writer_id = 1"), state, o).collect()] for o in (True, False)} == {True: ["ACCEPT"] * 2, False: ["ERROR"] * 2}
    (tmp_path / "s").mkdir()
    schema, out = '{"type":"record","name":"U","fields":[{"name":"id","type":"long"}]}', bytearray()
    for i in range(3):
        avro.encode(avro.parse(schema), {"id": i}, out)
    (tmp_path / "s/x.bin").write_bytes(bytes(out))
    assert [r["id"] for r in avro.streams(spark, str(tmp_path / "s"), schema).collect()] == [0, 1, 2]
