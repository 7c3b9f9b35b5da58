"""Streaming forms: writer dedup with keyed state, and an idempotent sink with a commit log."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


class WriterDedup(StatefulProcessor):
    """ACCEPT, DUPLICATE or STALE for each request of a writer, against the largest sequence number before (one number of state).

    The requests of a micro-batch are put in arrival order here, as they may come in any. pipelined: a stale request passes
    if a larger number of the writer arrives later in the same flush.
    """

    def __init__(self, pipelined: bool = False, ttl_ms: int | None = None):
        self.pipelined, self.ttl_ms = pipelined, ttl_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "seq long", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("arrival", ignore_index=True)
        last = self.last.get()[0] if self.last.exists() else None
        later = pdf.iloc[::-1].groupby("flush_id")["append_seq"].transform(lambda s: s.shift(1).cummax()).iloc[::-1]
        out = []
        for seq, ahead in zip(pdf["append_seq"].tolist(), later.tolist(), strict=True):
            if last is None or seq > last:
                out.append("ACCEPT")
            elif seq == last:
                out.append("DUPLICATE")
            else:
                out.append("ACCEPT" if self.pipelined and ahead == ahead and ahead is not None and ahead > seq else "STALE")
            last = seq if last is None else max(last, seq)
        if last is not None:
            self.last.update((int(last),))
        yield pd.DataFrame({"arrival": pdf["arrival"], "writer_id": pdf["writer_id"], "append_seq": pdf["append_seq"], "decision": out})

    def close(self) -> None:
        pass


def dedup_stream(arrivals: DataFrame, pipelined: bool = False, ttl_ms: int | None = None) -> DataFrame:
    """The streaming twin of operators.append.classified; needs the RocksDB state store. ttl_ms: a writer not heard of for so long is
    forgotten, which bounds the state."""
    return arrivals.groupBy("writer_id").transformWithStateInPandas(WriterDedup(pipelined, ttl_ms), "arrival long, writer_id long, append_seq long, decision string", "Append", "ProcessingTime" if ttl_ms else "None")


def idempotent_sink(path: str, project: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch lies in a folder of its own and is written whole anew if its id comes again, so a retry adds nothing.

    Readers take the folders that hold Spark's success mark; a batch that died half-way is not among them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        project(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch_id}")

    return write


def committed(spark, path: str) -> DataFrame:
    """The rows of all batches that were written to the end, with their batch id."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [str(s.getPath()) for s in fs.listStatus(jpath) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS"))]
    if not done:
        raise ValueError(f"no batch of {path} has been written to the end")
    return spark.read.option("basePath", path).parquet(*done)


def offsets_batch(state: dict[int, int] | None, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offsets for the accepted records of a micro-batch, going on from each topic's next offset (state); and the counts to add to it."""
    from tidelog.operators.append import segments

    nexts = batch.sparkSession.createDataFrame(list((state or {}).items()), "topic_id long, base long")
    seg = segments(batch).join(nexts, "topic_id", "left").withColumn("base", F.coalesce("base", F.lit(0)))
    moved = seg.withColumn("start_offset", F.col("start_offset") + F.col("base")).withColumn("end_offset", F.col("end_offset") + F.col("base")).drop("base")
    return moved, moved.groupBy("topic_id").agg(F.max("end_offset").alias("next_offset"))
