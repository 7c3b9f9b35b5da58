"""Ingest, consume, drain and metrics as streams."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidelog.sources import avro
from tidelog.sources.seglog import ObjectStore
from tidelog.streaming.dedup import offsets_batch


def flushes(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a micro-batch is a flush. Its records (topic_id, flush_id, schema_id, event_id, size, ts_us, key, value) are written
    first, then its index with offsets that go on from the flush before, then a commit that makes both count. A batch that comes
    again is written anew if it was not committed, else left alone; records without a commit are orphans that nobody reads."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store = ObjectStore(path)
        name = f"commits/{batch_id:020d}.json"
        known = store.list("commits/")
        if name in known:
            return
        earlier = [k for k in known if k < name]
        nexts = {int(k): v for k, v in json.loads(store.get(earlier[-1]))["next"].items()} if earlier else {}
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/records/{batch_id}")
        index, moved = offsets_batch(nexts, batch.sparkSession.read.parquet(f"{path}/records/{batch_id}"))
        index.write.mode("overwrite").parquet(f"{path}/index/{batch_id}")
        nexts |= {r["topic_id"]: r["next_offset"] for r in moved.collect()}  # a row for each topic
        store.put(name, json.dumps({"batch": batch_id, "next": nexts}).encode())

    return write


def flushed(spark: SparkSession, path: str, what: str = "index") -> DataFrame:
    """The index, or the records, of all committed flushes."""
    done = [json.loads(ObjectStore(path).get(k))["batch"] for k in ObjectStore(path).list("commits/")]
    return spark.read.parquet(*(f"{path}/{what}/{b}" for b in done)) if done else spark.createDataFrame([], "topic_id long")


def consume(spark: SparkSession, log_path: str, topic: int, schema: str, handle: Callable[[DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Calls handle with the decoded records of each batch of a topic; progress is committed after it returns, so each record comes at
    least once. A reader that begins again goes on from its checkpoint."""
    stream = spark.readStream.format("seglog").option("topic_id", topic).load(log_path)
    run = lambda batch, _: handle(avro.decode_column(batch, "value", schema))
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(run).start()


def drain(query: StreamingQuery, seconds: int = 25) -> bool:
    """Lets the query finish what is there, for so many seconds at most, then stops it; whether it was done in time."""
    from threading import Thread

    work = Thread(target=query.processAllAvailable, daemon=True)
    work.start()
    work.join(seconds)
    done = not work.is_alive()
    query.stop()
    return done


#: Upper bounds of the duration histogram, in milliseconds.
BOUNDS = (5, 10, 25, 50, 100, 250, 500, 1_000, 2_500, 5_000, 10_000)


class Metrics(StreamingQueryListener):
    """Counters and a duration histogram of streaming queries, as Prometheus text."""

    def __init__(self):
        self.rows, self.batches, self.started, self.stopped, self.failed, self.counts, self.total_ms = 0, 0, 0, 0, 0, [0] * (len(BOUNDS) + 1), 0

    def onQueryStarted(self, event) -> None:
        self.started += 1

    def onQueryProgress(self, event) -> None:
        self.observe(event.progress.numInputRows, event.progress.durationMs.get("triggerExecution", 0))

    def observe(self, rows: int, ms: int) -> None:
        self.rows, self.batches, self.total_ms = self.rows + rows, self.batches + 1, self.total_ms + ms
        self.counts[next((i for i, b in enumerate(BOUNDS) if ms <= b), len(BOUNDS))] += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.stopped += 1
        self.failed += event.exception is not None

    def text(self) -> str:
        lines = [f"tidelog_{k}_total {v}" for k, v in (("rows", self.rows), ("batches", self.batches), ("queries_started", self.started), ("queries_stopped", self.stopped), ("queries_failed", self.failed))]
        run = 0
        for bound, n in zip([*map(str, BOUNDS), "+Inf"], self.counts, strict=True):
            run += n
            lines.append(f'tidelog_batch_ms_bucket{{le="{bound}"}} {run}')
        return "\n".join([*lines, f"tidelog_batch_ms_sum {self.total_ms}", f"tidelog_batch_ms_count {self.batches}", ""])


def latencies(events: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, and the approximate quantiles p50, p99, p999 of value."""
    q = F.percentile_approx(value, [0.5, 0.99, 0.999], 100_000)
    return events.groupBy(key).agg(F.count("*").alias("n"), q.alias("q")).select(key, "n", *(F.col("q")[i].alias(c) for i, c in enumerate(("p50", "p99", "p999"))))
