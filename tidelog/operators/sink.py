"""Table sink: claims and catch-up, flush choice, projection of writer schemas to the reader's, evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

META = ("_offset", "_partition_id", "_ingest_time", "_key")


def unclaimed(index: DataFrame, claims: DataFrame, topics: list[int], n: int) -> DataFrame:
    """The first n segments of the topics without a claim."""
    free = index.where(F.col("topic_id").isin(topics)).join(claims.select("batch_id"), "batch_id", "left_anti")
    return free.select("batch_id", "topic_id", "start_offset").orderBy("start_offset", "batch_id").limit(n)


def claimed(claims: DataFrame, done: DataFrame) -> DataFrame:
    """batch_id, status after batches were completed, claimed before or not; completed wins."""
    every = claims.select("batch_id", "status").unionByName(done.select("batch_id", F.lit("completed").alias("status")))
    return every.groupBy("batch_id").agg(F.min("status").alias("status"))  # "completed" < "pending"


def stale_claims(claims: DataFrame, now: DataFrame, older_us: int) -> DataFrame:
    return claims.crossJoin(F.broadcast(now)).where((F.col("status") == "pending") & (F.col("claimed_us") < F.col("now_us") - older_us)).select("batch_id")


def catchup_groups(index: DataFrame) -> DataFrame:
    """Segments by object (a flush), so that each object is read once: how many, and its bytes."""
    return index.groupBy("flush_id").agg(F.count("*").alias("n_segments"), F.sum("byte_length").alias("bytes"), F.sort_array(F.collect_list("batch_id")).alias("ids")).select("flush_id", "n_segments", "bytes", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("batch_ids"))


def flush_victims(index: DataFrame, cap: int) -> DataFrame:
    """Topics to flush, largest buffer first, until what stays is at most cap bytes: topic_id, bytes, flush_no."""
    size = index.groupBy("topic_id").agg(F.sum("byte_length").alias("bytes"))
    by = Window.orderBy(F.col("bytes").desc(), "topic_id")  # a row per topic
    rows = size.select("topic_id", "bytes", F.row_number().over(by).cast("long").alias("flush_no"), F.sum("bytes").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("held"))
    return rows.where(F.col("held") > cap).select("topic_id", "bytes", "flush_no")


def projected(rows: DataFrame, fields: list[tuple[str, str, str | None, Column | None]]) -> DataFrame:
    """rows of one writer schema in the reader's shape.

    fields: (reader name, type, writer name or None, default). A writer's column is cast to the reader's type (int to bigint, float
    to double); without one the default or null. Metadata columns follow.
    """
    cols = [(F.col(src) if src else (F.lit(None) if default is None else default)).cast(kind).alias(name) for name, kind, src, default in fields]
    return rows.select(*cols, *META)


def with_metadata(rows: DataFrame, offset: Column, topic: Column, ingest: Column, key: Column) -> DataFrame:
    return rows.withColumns(dict(zip(META, (offset, topic.cast("int"), ingest, key), strict=True)))


def schema_diff(old: DataFrame, new: DataFrame, renames: DataFrame, deletions: DataFrame) -> DataFrame:
    """table_name, op, column_name, detail between field tables (table_name, column_name, type) and the hints of the newer schema.

    A rename (table_name, old_name, column_name) that holds on both sides is RENAME, an old column named in deletions is DELETE, a
    column on both sides whose type grew (int to long, float to double) is WIDEN, a new one without rename is ADD. A column
    that vanished without a hint gives nothing.
    """
    o, n = old.toDF("t", "o_name", "o_type"), new.toDF("t", "n_name", "n_type")
    r = renames.toDF("t", "o_name", "n_name").join(o, ["t", "o_name"]).join(n, ["t", "n_name"])
    ops = [r.select("t", F.lit("RENAME").alias("op"), F.col("n_name").alias("c"), F.col("o_name").alias("d"))]
    ops.append(deletions.toDF("t", "o_name").join(o, ["t", "o_name"]).select("t", F.lit("DELETE").alias("op"), F.col("o_name").alias("c"), F.lit("").alias("d")))
    grew = ((F.col("o_type") == "int") & (F.col("n_type") == "long")) | ((F.col("o_type") == "float") & (F.col("n_type") == "double"))
    both = o.join(n, (o["t"] == n["t"]) & (F.col("o_name") == F.col("n_name"))).select(o["t"], "n_name", "o_type", "n_type").unionByName(r.select("t", "n_name", "o_type", "n_type"))
    ops.append(both.where(grew).select("t", F.lit("WIDEN").alias("op"), F.col("n_name").alias("c"), F.concat("o_type", F.lit(">"), "n_type").alias("d")))
    known = both.select("t", "n_name")
    ops.append(n.join(known, ["t", "n_name"], "left_anti").select("t", F.lit("ADD").alias("op"), F.col("n_name").alias("c"), F.col("n_type").alias("d")))
    out = ops[0]
    for x in ops[1:]:
        out = out.unionByName(x)
    return out.toDF("table_name", "op", "column_name", "detail")
