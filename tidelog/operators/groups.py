"""Reader groups: leases, commits, rollbacks, watermarks, greedy dispatch. Every step is a function of tables and of `now`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.append import running_total
from tidelog.operators.tables import cut

#: Offsets, and segments, in a block of the two-phase windows.
OFFSETS, SEGMENTS = 65_536, 1_000


def joined(members: DataFrame, requests: DataFrame) -> DataFrame:
    """Members after join requests (group_id, reader_id, heartbeat_us): inserted if absent, else the heartbeat moves on."""
    return members.unionByName(requests).groupBy("group_id", "reader_id").agg(F.max("heartbeat_us").alias("heartbeat_us"))


def committed_watermark(cursors: DataFrame, inflight: DataFrame) -> DataFrame:
    """The smallest leased offset, or the dispatch cursor if nothing is leased."""
    low = inflight.groupBy("group_id", "topic_id").agg(F.min("start_offset").alias("low"))
    return cursors.join(low, ["group_id", "topic_id"], "left").select("group_id", "topic_id", F.coalesce("low", "dispatch_cursor").alias("committed_watermark"))


def cursor_rollback(cursors: DataFrame, deleted: DataFrame) -> DataFrame:
    """The dispatch cursor after the leases `deleted` were taken back: never beyond their smallest start."""
    low = deleted.groupBy("group_id", "topic_id").agg(F.min("start_offset").alias("low"))
    return cursors.join(low, ["group_id", "topic_id"], "left").select("group_id", "topic_id", F.least("dispatch_cursor", F.coalesce("low", "dispatch_cursor")).alias("dispatch_cursor"))


def expired_members(members: DataFrame, now: DataFrame, session_us: int) -> DataFrame:
    """Members whose heartbeat is older than the session timeout (strictly). now: one row, now_us."""
    return members.crossJoin(F.broadcast(now)).where(F.col("heartbeat_us") < F.col("now_us") - session_us).select("group_id", "reader_id", "heartbeat_us")


def expired_lease(inflight: DataFrame, now: DataFrame) -> DataFrame:
    """Per topic the lease with the lowest start among those that expired before now: the next one to steal."""
    old = inflight.crossJoin(F.broadcast(now)).where(F.col("expires_us") < F.col("now_us"))
    low = old.groupBy("topic_id").agg(F.min(F.struct("start_offset", "end_offset", "reader_id")).alias("s"))
    return low.select("topic_id", "s.start_offset", "s.end_offset", F.col("s.reader_id").alias("old_reader"))


def renewed(inflight: DataFrame, reader: str, now: DataFrame, lease_us: int) -> DataFrame:
    """Leases after a heartbeat of the reader: its own run from now on."""
    at = F.when(F.col("reader_id") == reader, F.col("now_us") + lease_us).otherwise(F.col("expires_us"))
    return inflight.crossJoin(F.broadcast(now)).select("group_id", "topic_id", "start_offset", "end_offset", "reader_id", at.alias("expires_us"))


def inflight_per_reader(inflight: DataFrame, most: int) -> DataFrame:
    n = inflight.groupBy("group_id", "topic_id", "reader_id").agg(F.count("*").alias("inflight"))
    return n.withColumn("at_limit", F.col("inflight") >= most)


def commits(inflight: DataFrame, requests: DataFrame) -> DataFrame:
    """Each commit request with OK if exactly that range is leased to that reader, else NOT_OWNER."""
    keys = ["group_id", "topic_id", "start_offset", "end_offset", "reader_id"]
    held = inflight.select(*keys, F.lit(True).alias("held"))
    return requests.join(held, keys, "left").select("topic_id", "start_offset", "end_offset", "reader_id", F.when(F.col("held"), "OK").otherwise("NOT_OWNER").alias("status"))


def after_leave(cursors: DataFrame, inflight: DataFrame, gone: Column) -> DataFrame:
    """group_id, topic_id, dispatch_cursor, committed_watermark once the leases `gone` are taken back (leave, eviction, forced removal)."""
    cursor = cursor_rollback(cursors, inflight.where(gone))
    mark = committed_watermark(cursor, inflight.where(~gone))
    return cursor.join(mark, ["group_id", "topic_id"])


def force_reset(cursors: DataFrame, inflight: DataFrame) -> DataFrame:
    """Leases and members dropped: the cursor goes back to the committed watermark."""
    return committed_watermark(cursors, inflight).select("group_id", "topic_id", F.col("committed_watermark").alias("dispatch_cursor"))


def grants(index: DataFrame, max_bytes: int, most: int = 10) -> DataFrame:
    """For each segment the range a poll would lease if the cursor stood at its start: segments until max_bytes (the crossing one
    included), `most` at the most. topic_id, start_offset, end_offset, n_segments. Segments are dealt in blocks, so no topic is one task."""
    seg = index.select("topic_id", "start_offset", "end_offset", "byte_length", F.expr(f"start_offset div {OFFSETS}").alias("__coarse"), F.lit(1).alias("__one"))
    seg = running_total(seg, "topic_id", "__coarse", ["start_offset"], "__one", "n").withColumn("block", F.expr(f"(n - 1) div {SEGMENTS}"))
    late = seg.where((F.col("block") > 0) & (F.expr(f"(n - 1) % {SEGMENTS}") < most - 1)).withColumn("block", F.col("block") - 1)  # what the block before looks ahead to
    index = seg.withColumn("own", F.lit(True)).unionByName(late.withColumn("own", F.lit(False)))
    by = Window.partitionBy("topic_id", "block").orderBy("start_offset")
    ahead = F.collect_list(F.struct("end_offset", "byte_length")).over(by.rowsBetween(0, most - 1))
    n = F.expr("aggregate(ahead, named_struct('n', 0, 'b', 0L), (a, x) -> IF(a.b >= {0}, a, named_struct('n', a.n + 1, 'b', a.b + x.byte_length)), a -> a.n)".format(int(max_bytes)))
    rows = index.select("topic_id", "start_offset", "own", ahead.alias("ahead")).where("own").withColumn("n", n)
    return rows.select("topic_id", "start_offset", F.expr("ahead[n - 1].end_offset").alias("end_offset"), F.col("n").cast("long").alias("n_segments"))


def poll_next(index: DataFrame, cursor: int, max_bytes: int) -> DataFrame:
    """One poll per topic from a cursor: the cursor may lie inside a segment, whose rest is then leased."""
    first = index.where(F.col("end_offset") > cursor)
    at = F.min_by(F.struct("start_offset", "end_offset", "n_segments"), "start_offset").alias("g")
    got = grants(first, max_bytes).groupBy("topic_id").agg(at)
    return got.select("topic_id", F.greatest("g.start_offset", F.lit(cursor).cast("long")).alias("start_offset"), "g.end_offset", "g.n_segments")


def poll_sequence(index: DataFrame, max_bytes: int) -> DataFrame:
    """topic_id, step, start_offset, end_offset: the leases of polls that follow each other from offset 0 to the end.

    Dispatch is a chain through the segments, followed by doubling: with the jumps over 2**k polls, the chain of the first 2**k
    leases gives that of 2**(k+1). So there are log2(leases) joins of the index with itself instead of a step per lease. Rounds are checkpointed: each uses the one before twice.
    """
    g = cut(grants(index, max_bytes).select("topic_id", "start_offset", "end_offset"))
    most = g.groupBy("topic_id").count().agg(F.max("count").alias("n")).first()["n"] or 0
    chain = g.where("start_offset = 0").select("topic_id", F.lit(0).cast("long").alias("step"), "start_offset")
    jump = g.select("topic_id", F.col("start_offset").alias("at"), F.col("end_offset").alias("to"))
    for k in range(max(0, int(most - 1)).bit_length()):
        far = chain.join(jump, (chain["topic_id"] == jump["topic_id"]) & (chain["start_offset"] == jump["at"])).select(chain["topic_id"], (F.col("step") + (1 << k)).alias("step"), F.col("to").alias("start_offset"))
        chain = cut(chain.unionByName(far))
        a, b = jump.toDF("topic_id", "at", "mid"), jump.toDF("t", "mid2", "to")
        jump = cut(a.join(b, (F.col("topic_id") == F.col("t")) & (F.col("mid") == F.col("mid2"))).select("topic_id", "at", "to"))
    return chain.join(g, ["topic_id", "start_offset"]).select("topic_id", "step", "start_offset", "end_offset")


def member_counts(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Members of each (group, topic); 0 for empty groups."""
    n = members.groupBy("group_id").agg(F.count("*").alias("n"))
    return groups.join(n, "group_id", "left").select("group_id", "topic_id", F.coalesce("n", F.lit(0)).alias("member_count"))


def detail(members: DataFrame, inflight: DataFrame) -> DataFrame:
    """group_id, reader_id, heartbeat_us, n_leases, low_offset of every member."""
    held = inflight.groupBy("group_id", "reader_id").agg(F.count("*").alias("n"), F.min("start_offset").alias("low_offset"))
    return members.join(held, ["group_id", "reader_id"], "left").select("group_id", "reader_id", "heartbeat_us", F.coalesce("n", F.lit(0)).alias("n_leases"), "low_offset")


def cursor_lag(cursors: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Cursor beside the high watermark of its topic (0 if it has none), and whether a poll would find anything."""
    both = cursors.join(watermarks, "topic_id", "left").withColumn("high_watermark", F.coalesce("high_watermark", F.lit(0)).cast("long"))
    return both.select("group_id", "topic_id", "dispatch_cursor", "high_watermark", (F.col("dispatch_cursor") < F.col("high_watermark")).alias("has_more"))
