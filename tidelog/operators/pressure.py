"""Buffers: when to flush, when to push back, whose state to forget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flush_due(buffers: DataFrame, now: DataFrame, most_bytes: int, most_us: int) -> DataFrame:
    """buffers (topic_id, bytes, oldest_us) with why each is due: SIZE, AGE, or null. now: one row, now_us."""
    why = F.when(F.col("bytes") >= most_bytes, "SIZE").when(F.col("now_us") - F.col("oldest_us") >= most_us, "AGE")
    return buffers.crossJoin(F.broadcast(now)).select("topic_id", "bytes", "oldest_us", why.alias("due"))


def backpressure(levels: DataFrame, high: int, low: int, key: str = "broker", order: str = "step") -> DataFrame:
    """levels (key, step, bytes, flushed) with pushing: from a level of high on, until a successful flush leaves low or less."""
    turn = F.when(F.col("bytes") >= high, True).when(F.col("flushed") & (F.col("bytes") <= low), False)
    return levels.withColumn("pushing", F.coalesce(F.last(turn, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))


def evicted(state: DataFrame, capacity: int) -> DataFrame:
    """writer_id of the states (writer_id, inserted) beyond the capacity: the oldest by insertion, whenever they were last used."""
    over = max(0, state.count() - capacity)
    return state.orderBy("inserted", "writer_id").limit(over).select("writer_id")


def retry_delays(attempts: int = 5, first_s: float = 0.1, most_s: float = 10.0) -> list[float]:
    """Seconds before each further attempt: doubled from one to the next, up to a bound."""
    return [min(most_s, first_s * 2**k) for k in range(attempts)]


class PushedBack(RuntimeError):
    """A request that was refused for now."""


def with_retries(send, request, sleep, attempts: int = 5, first_s: float = 0.1, most_s: float = 10.0):
    """send(request), again with the same request (and its sequence number) while it is pushed back; other errors pass."""
    for delay in retry_delays(attempts, first_s, most_s):
        try:
            return send(request)
        except PushedBack:
            sleep(delay)
    return send(request)
