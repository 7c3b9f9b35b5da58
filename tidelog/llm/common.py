"""What the operators share: the shared work folder, written intermediate tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this many are broadcast for a semi or anti join (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and all run on one machine (tests), below a temporary one that is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidelog-{uuid.uuid4().hex}"


#: The folders written since each scratch() that is open began, the innermost last.
OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that written() makes inside are deleted at the end, but for those with keep: they belong to the scratch() around, if any."""
    OPEN.append([])
    try:
        yield
    finally:
        for path in OPEN.pop():
            remove(spark, path)


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Inside, the files of a shuffle are deleted once the action that made it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and reread: cuts the lineage and survives lost executors."""
    path = work_dir(df.sparkSession)
    if len(OPEN) > keep:
        OPEN[-1 - keep].append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a work folder on whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def below(share: float, *cols) -> Column:
    """Whether the 63-bit hash of the columns is in the lowest share of its range; exact enough for a share of 1e-15."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1) < F.lit(min(int(share * 2.0**63), (1 << 63) - 1))


def sampled(df: DataFrame, rows: int, most: int, *cols: str) -> DataFrame:
    """Of the `rows` rows of df about `most` at the most, taken by a hash of cols; rows that are equal in cols come once.

    The share taken is computed from the number of rows, so the sample is spread over the table. If nothing was taken though there
    are rows (a table of a few texts repeated), it is the first `most` by that hash."""
    mark = F.xxhash64(F.lit("sample"), *cols)
    part = df if rows <= most else df.where(below(most / rows, F.lit("sample"), *cols))
    part = part.withColumn("__mark", mark).dropDuplicates(["__mark"])
    if rows > most and part.isEmpty():
        part = df.withColumn("__mark", mark).dropDuplicates(["__mark"]).orderBy("__mark").limit(most)
    return part.drop("__mark")


def kept_rows(df: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """df semi- or anti-joined ("left_semi", "left_anti") with the one-column table ids on df[key].

    ids must be cheap to count (a written table). It is broadcast only if it has at most BROADCAST_IDS rows.
    """
    other = ids.toDF("__kept_rows_id")
    if ids.count() <= BROADCAST_IDS:
        other = F.broadcast(other)
    return df.join(other, df[key] == other["__kept_rows_id"], how)


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null id counts as remainder -1."""
    return F.coalesce(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % n, F.lit(-1))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Rows of an Arrow batch that are worked on at once, so that Python holds few texts at a time.
SLICE = 512


def map_texts(docs: DataFrame, id_col: str, text_col: str, make, schema: str, more: tuple = ()) -> DataFrame:
    """mapInArrow over (id, text, *more columns): make() is called in each task and gives a function of (ids, texts, *more) to a dict of columns.

    Ids and texts are lists; a null text arrives as "". The function may also return None for no rows.
    """
    fields = docs.sparkSession.createDataFrame([], schema).schema
    cols = [F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(c if isinstance(c, Column) else F.col(c) for c in more)]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out, work = to_arrow_schema(fields), make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                got = work(*(c.to_pylist() for c in batch.slice(at, SLICE).columns))
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)
        end = getattr(work, "end", None)
        if end is not None:
            for got in end():
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return docs.select(*cols).mapInArrow(run, fields)
