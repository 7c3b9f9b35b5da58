"""Table sink: decoded segments as rolling Parquet files with a manifest, claims of what was taken in, and the catch-up job.

A table is a folder: ``_table.json`` (its name and schema), ``_manifest`` (a file per commit, that lists the commit's batches) and ``data`` (a folder
per commit). Readers take the folders that the manifest lists, so a commit is all or nothing, and one that comes again adds nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.append import running_total
from tidelog.operators.sink import META
from tidelog.sources import avro
from tidelog.sources.seglog import ObjectStore

#: Parquet settings of data files: row groups of 128 MiB, pages of 1 MiB; and most rows in a file, which keeps it near 256 MiB.
PARQUET = {"compression": "zstd", "parquet.block.size": str(128 << 20), "parquet.page.size": str(1 << 20), "parquet.enable.dictionary": "true"}
FILE_ROWS = 2_000_000


class SinkTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path, ObjectStore(path)

    def ensure(self, name: str, schema: str) -> bool:
        """Creates the table with the Avro reader schema if there is none; whether it did. A newer schema that can read the table's
        takes its place (columns come in, types widen)."""
        type_of = avro.with_field_ids(schema)
        if "_table.json" not in self.store.list("_table.json"):
            self.store.put("_table.json", json.dumps({"name": name, "avro": schema, "schema": type_of.jsonValue()}).encode())
            return True
        old = self.about()["avro"]
        if old != schema:
            if not avro.compatible(schema, old):
                raise avro.SchemaError(f"the schema can't read what is in table {name}")
            self.store.put("_table.json", json.dumps({"name": name, "avro": schema, "schema": type_of.jsonValue()}).encode())
        return False

    def about(self) -> dict:
        return json.loads(self.store.get("_table.json"))

    def commits(self) -> dict[str, dict]:
        return {k.removeprefix("_manifest/").removesuffix(".json"): json.loads(self.store.get(k)) for k in self.store.list("_manifest/")}

    def append(self, commit: str, rows: DataFrame, batches: list[int]) -> bool:
        """Writes rows as the commit of these batches; False if it was there already."""
        if f"_manifest/{commit}.json" in self.store.list("_manifest/"):
            return False
        rows.write.mode("overwrite").options(**PARQUET).option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.path}/data/{commit}")
        self.store.put(f"_manifest/{commit}.json", json.dumps({"batches": batches, "avro": self.about()["avro"]}).encode())
        return True

    def read(self) -> DataFrame:
        """All committed rows in the table's schema: columns that a commit has not are null, narrower ones are widened."""
        now = T.StructType.fromJson(self.about()["schema"])
        fields = [*(T.StructField(f.name, f.dataType, True) for f in now), *META_TYPE]
        by_schema: dict[str, list[str]] = {}
        for commit, about in self.commits().items():
            by_schema.setdefault(about["avro"], []).append(f"{self.path}/data/{commit}")
        out = self.spark.createDataFrame([], T.StructType(fields))
        for schema, paths in by_schema.items():
            rows = self.spark.read.schema(T.StructType([*avro.spark_type(avro.parse(schema)).fields, *META_TYPE])).parquet(*paths)
            out = out.unionByName(rows.select(*avro.projection(self.about()["avro"], schema), *META))
        return out


META_TYPE = [T.StructField("_offset", T.LongType()), T.StructField("_partition_id", T.IntegerType()), T.StructField("_ingest_time", T.TimestampType()), T.StructField("_key", T.BinaryType())]


def index_of(log: DataFrame) -> DataFrame:
    """The segment index of a log read by format("seglog"): topic_id, schema_id, file, byte_offset, start_offset, end_offset, batch_id.

    Offsets follow the objects' names, which begin with their time; batch_id tells file and place apart."""
    seg = log.groupBy("topic_id", "schema_id", "file", "byte_offset").agg(F.count("*").alias("record_count"))
    seg = seg.withColumn("__day", F.expr("try_cast(split_part(file, '-', 1) AS bigint) div 86400000"))
    seg = running_total(seg, "topic_id", "__day", ["file", "byte_offset"], "record_count", "end_offset").drop("__day")
    return seg.withColumn("start_offset", F.col("end_offset") - F.col("record_count")).withColumn("batch_id", F.xxhash64("file", "byte_offset"))


def write_segments(table: SinkTable, commit: str, log_path: str, topic: int, segments: DataFrame, schemas: dict[int, str]) -> bool:
    """Takes the segments (rows of index_of) of one topic into the table: decodes each writer schema's records, projects them to the table's
    schema, adds the metadata columns. schemas: Avro schema by schema_id; an id without one is an error. Check values are compared."""
    reader, rows = table.about()["avro"], None
    ids = [r["schema_id"] for r in segments.select("schema_id").distinct().collect()]  # the versions of a topic's schema
    place = segments.select("file", "byte_offset", "start_offset")
    for i in ids:
        if i not in schemas:
            raise ValueError(f"schema {i} is not known")
        log = table.spark.read.format("seglog").option("topic_id", topic).option("schema_id", i).load(log_path)
        records = log.join(place, ["file", "byte_offset"])
        decoded = avro.decode_column(records.select("value", (F.col("start_offset") + F.col("position")).alias("_offset"), F.col("topic_id").cast("int").alias("_partition_id"), F.timestamp_micros("ingest_us").alias("_ingest_time"), F.col("key").alias("_key")), "value", schemas[i])
        part = decoded.select(*avro.projection(reader, schemas[i]), *META)
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return False
    return table.append(commit, rows, sorted(r["batch_id"] for r in segments.select("batch_id").collect()))


class Claims:
    """What the sink has taken in: a file per claim of batches, pending until the same name is completed. Claims are few: one per commit."""

    def __init__(self, path: str):
        self.store = ObjectStore(path)

    def all(self) -> dict[str, dict]:
        return {k.removesuffix(".json"): json.loads(self.store.get(k)) for k in self.store.list() if k.endswith(".json")}

    def claim(self, name: str, batches: list[int], now_us: int) -> None:
        self.store.put(f"{name}.json", json.dumps({"status": "pending", "batches": batches, "claimed_us": now_us}).encode())

    def complete(self, name: str, batches: list[int], now_us: int) -> None:
        self.store.put(f"{name}.json", json.dumps({"status": "completed", "batches": batches, "claimed_us": now_us}).encode())

    def expire(self, now_us: int, older_us: int) -> list[str]:
        """Deletes pending claims that are too old; their names."""
        old = [k for k, c in self.all().items() if c["status"] == "pending" and c["claimed_us"] < now_us - older_us]
        for k in old:
            self.store.delete(f"{k}.json")
        return old

    def taken(self) -> set[int]:
        return {b for c in self.all().values() for b in c["batches"]}


def catch_up(spark: SparkSession, log_path: str, topics: dict[int, SinkTable], schemas: dict[int, str], claims: Claims, now_us: Callable[[], int], most: int = 100, expiry_us: int = 300_000_000) -> int:
    """Takes in everything of the topics that has no claim, at most `most` objects a commit so that each object is read once; returns the
    number of commits. Claims of a run that died expire and are taken again; a commit that is in the table already adds nothing."""
    claims.expire(now_us(), expiry_us)
    done = 0
    for topic, table in sorted(topics.items()):
        index = index_of(spark.read.format("seglog").option("topic_id", topic).load(log_path))
        known = claims.taken() | {b for c in table.commits().values() for b in c["batches"]}
        gone = spark.createDataFrame([(b,) for b in known], "batch_id long")
        todo = index.join(gone, "batch_id", "left_anti").select(*index.columns).orderBy("start_offset").collect()  # the index of what is not taken in yet
        files = sorted({r["file"] for r in todo})
        for at in range(0, len(files), most):
            part = [r for r in todo if r["file"] in set(files[at : at + most])]
            name, batches = f"{topic}-{min(r['start_offset'] for r in part):020d}", sorted(r["batch_id"] for r in part)
            claims.claim(name, batches, now_us())
            done += write_segments(table, name, log_path, topic, spark.createDataFrame(part, index.schema), schemas)
            claims.complete(name, batches, now_us())
    return done
