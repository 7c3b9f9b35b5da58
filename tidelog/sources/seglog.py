"""Segment files: the object format of the log, its codec, and a Spark data source over it.

An object holds compressed segments back to back, then a footer that lists them, the footer's length (4 bytes, big-endian) and
a magic word. A segment's records are varint length and bytes of key and value in turn, -1 standing for a null key. Numbers in
the footer are varints, zigzag where they are signed; a segment's check value is taken over its compressed bytes.

Offsets in a footer are provisional (0): the index table is the only truth for them. The data source therefore numbers records
within their segment, and a reader joins the index for offsets.
"""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format.
MAGIC, ZSTD, LEVEL = b"FLRN", 0, 3


def put_u64(n: int, out: bytearray) -> None:
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def put_i64(n: int, out: bytearray) -> None:
    put_u64(2 * n if n >= 0 else -2 * n - 1, out)


def get_u64(data, at: int) -> tuple[int, int]:
    """The number and the place behind it."""
    n = shift = 0
    while True:
        if shift > 63:
            raise ValueError("a varint has over 64 bits")
        if at >= len(data):
            raise ValueError("a varint is cut short")
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def get_i64(data, at: int) -> tuple[int, int]:
    n, at = get_u64(data, at)
    return n >> 1 if n % 2 == 0 else -(n + 1 >> 1), at


def encode_records(records) -> bytes:
    out = bytearray()
    for key, value in records:
        put_i64(-1 if key is None else len(key), out)
        out += key or b""
        put_i64(len(value), out)
        out += value
    return bytes(out)


def decode_records(data: bytes, count: int | None = None) -> list[tuple[bytes | None, bytes]]:
    """Records of a segment; what follows the first `count` of them is not looked at."""
    out, at = [], 0
    while at < len(data) and (count is None or len(out) < count):
        n, at = get_i64(data, at)
        key = None if n < 0 else bytes(data[at : at + n])
        at += max(n, 0)
        n, at = get_i64(data, at)
        if n < 0 or at + n > len(data):
            raise ValueError("a record is cut short")
        out.append((key, bytes(data[at : at + n])))
        at += n
    return out


@dataclass(frozen=True)
class Segment:
    topic_id: int
    schema_id: int
    start_offset: int
    end_offset: int
    record_count: int
    byte_offset: int
    byte_length: int
    ingest_us: int
    codec: int
    crc32: int


#: Fields of a footer entry in order, and whether they are signed.
FOOTER = (("topic_id", True), ("schema_id", True), ("start_offset", False), ("end_offset", False), ("record_count", True), ("byte_offset", False), ("byte_length", False), ("ingest_us", False))


class ObjectWriter:
    """Builds an object: add() segments, then finish()."""

    def __init__(self):
        self.body, self.segments = bytearray(), []

    def add(self, topic_id: int, schema_id: int, records: list, ingest_us: int) -> Segment:
        import zstandard

        data = zstandard.ZstdCompressor(level=LEVEL).compress(encode_records(records))
        seg = Segment(topic_id, schema_id, 0, 0, len(records), len(self.body), len(data), ingest_us, ZSTD, zlib.crc32(data))
        self.body += data
        self.segments.append(seg)
        return seg

    def finish(self) -> bytes:
        out = bytearray()
        put_i64(len(self.segments), out)
        for s in self.segments:
            for name, signed in FOOTER:
                (put_i64 if signed else put_u64)(getattr(s, name), out)
            out += struct.pack(">BI", s.codec, s.crc32)
        return bytes(self.body) + bytes(out) + struct.pack(">I", len(out)) + MAGIC


def read_footer(data: bytes) -> list[Segment]:
    if len(data) < 8:
        raise ValueError("an object is too small")
    if data[-4:] != MAGIC:
        raise ValueError("an object has the wrong magic word")
    (size,) = struct.unpack(">I", data[-8:-4])
    if size > len(data) - 8:
        raise ValueError("a footer is longer than its object")
    foot = data[len(data) - 8 - size : len(data) - 8]
    n, at = get_i64(foot, 0)
    out = []
    for _ in range(n):
        got = {}
        for name, signed in FOOTER:
            got[name], at = (get_i64 if signed else get_u64)(foot, at)
        codec, crc = struct.unpack_from(">BI", foot, at)
        if codec != ZSTD:
            raise ValueError(f"unknown codec {codec}")
        at += 5
        out.append(Segment(**got, codec=codec, crc32=crc))
    return out


def read_segment(data: bytes, seg: Segment, verify: bool = True) -> list[tuple[bytes | None, bytes]]:
    """Records of a segment of the object; the check value is compared before anything is decompressed."""
    import zstandard

    raw = data[seg.byte_offset : seg.byte_offset + seg.byte_length]
    if len(raw) < seg.byte_length:
        raise ValueError("a segment reaches beyond its object")
    if verify and zlib.crc32(raw) != seg.crc32:
        raise ValueError("a segment has the wrong check value")
    return decode_records(zstandard.ZstdDecompressor().decompressobj().decompress(raw), seg.record_count)


def store_of(path: str) -> tuple:
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def object_files(path: str) -> list[str]:
    from pyarrow import fs

    store, base = store_of(path)
    info = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted(f.path for f in info if f.is_file and f.path.endswith(".fl"))


class Part(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


def footer_of(f) -> list[Segment]:
    """The segments of an open object; only its end is read."""
    size = f.size()
    foot = struct.unpack(">I", f.read_at(4, size - 8))[0] if size >= 8 else 0
    tail = min(size, foot + 8)
    return read_footer(f.read_at(tail, size - tail))


class SegmentScan:
    """Reads objects in tasks: footers too, so the driver only lists. With the options topic_id or schema_id, other segments are left out
    before any of their bytes is read. (Options, not pushed filters: two scans of one load() share a reader, and with it what was
    pushed for one of them.) Records leave as Arrow batches, one for each segment."""

    def __init__(self, options):
        self.path, self.verify = options["path"], options.get("verify", "true") == "true"
        self.equal = {k: int(options[k]) for k in ("topic_id", "schema_id") if options.get(k)}

    def read(self, part: Part):
        store = store_of(self.path)[0]
        for name in part.files:
            with store.open_input_file(name) as f:
                for s in footer_of(f):
                    if all(getattr(s, k) == v for k, v in self.equal.items()):
                        here = Segment(**{**s.__dict__, "byte_offset": 0})
                        yield batch_of(s, name.rsplit("/", 1)[1], read_segment(f.read_at(s.byte_length, s.byte_offset), here, self.verify))


def batch_of(s: Segment, file: str, records: list):
    import pyarrow as pa

    n = len(records)
    long = lambda x: pa.array([x] * n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [long(s.topic_id), long(s.schema_id), pa.array([file] * n), long(s.byte_offset), pa.array(range(n), pa.int64()), long(s.ingest_us), pa.array([r[0] for r in records], pa.binary()), pa.array([r[1] for r in records], pa.binary())],
        names=[c.split()[0] for c in COLUMNS.split(", ")],
    )


COLUMNS = "topic_id long, schema_id long, file string, byte_offset long, position long, ingest_us long, key binary, value binary"
#: Objects that a task reads, in bytes, and at most so many; bytes of records after which a writer begins a new object.
TASK_BYTES, TASK_OBJECTS, ROLL_BYTES = 128 << 20, 256, 256 << 20


def packed(store, files: list[str]) -> list[Part]:
    """Objects in turn, so many to a task."""
    out, size = [], 0
    for info in store.get_file_info(files) if files else []:
        if not out or size + info.size > TASK_BYTES or len(out[-1]) >= TASK_OBJECTS:
            out.append([])
            size = 0
        out[-1].append(info.path)
        size += info.size
    return [Part(f) for f in out]


class SegmentReader(SegmentScan, DataSourceReader):
    def partitions(self):
        return packed(store_of(self.path)[0], object_files(self.path))


class SegmentStream(SegmentScan, DataSourceStreamReader):
    """Objects as they are committed: an offset is the number of commits seen, so nothing is read twice or left out."""

    def initialOffset(self):
        return {"commits": 0}

    def latestOffset(self):
        return {"commits": len(commits(self.path))}

    def partitions(self, start, end):
        store, base = store_of(self.path)
        return packed(store, [f"{base}/{f}" for c in commits(self.path)[start["commits"] : end["commits"]] for f in c])

    def commit(self, end):
        pass


def commits(path: str) -> list[list[str]]:
    """The names of the objects of each commit, in order."""
    from pyarrow import fs

    store, base = store_of(path)
    info = store.get_file_info(fs.FileSelector(f"{base}/_commits", allow_not_found=True))
    return [json.loads(store.open_input_stream(p).readall()) for p in sorted(f.path for f in info if f.path.endswith(".json"))]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class SegmentWriter(DataSourceWriter):
    """Objects of about ROLL_BYTES for each task; they get their names at the end, so that a task that dies leaves no readable file, and
    all of a write's are listed in one commit."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        import uuid

        store, base = store_of(self.path)
        store.create_dir(base, recursive=True)
        groups, ingest, held, names = {}, 0, 0, []

        def close():
            w = ObjectWriter()
            for (topic, schema), records in sorted(groups.items()):
                w.add(topic, schema, records, ingest)
            name = f"{base}/{ingest // 1000}-{uuid.uuid4().hex}"
            with store.open_output_stream(name + ".part") as f:
                f.write(w.finish())
            names.append(name)

        for r in rows:
            record = None if r.key is None else bytes(r.key), bytes(r.value)
            groups.setdefault((r.topic_id, r.schema_id), []).append(record)
            ingest, held = max(ingest, r.ingest_us), held + len(record[0] or b"") + len(record[1]) + 4
            if held >= ROLL_BYTES:
                close()
                groups, ingest, held = {}, 0, 0
        if groups:
            close()
        return Written(names)

    def commit(self, messages):
        store, base = store_of(self.path)
        names = sorted(f for m in messages if m is not None for f in m.files)
        for f in names:
            store.move(f + ".part", f + ".fl")
        if names:
            store.create_dir(f"{base}/_commits", recursive=True)
            number = f"{base}/_commits/{len(commits(self.path)):010d}"
            with store.open_output_stream(number + ".part") as f:
                f.write(json.dumps([n.rsplit("/", 1)[1] + ".fl" for n in names]).encode())
            store.move(number + ".part", number + ".json")

    def abort(self, messages):
        store, _ = store_of(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                store.delete_file(f + ".part")


class SegmentLog(DataSource):
    """format("seglog"): load(path) gives records, save(path) writes topic_id, schema_id, ingest_us, key, value; readStream follows the commits."""

    @classmethod
    def name(cls):
        return "seglog"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return SegmentReader(self.options)

    def streamReader(self, schema):
        return SegmentStream(self.options)

    def writer(self, schema, overwrite):
        return SegmentWriter(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(SegmentLog)


class ObjectStore:
    """Objects below a path, on any file system that pyarrow opens (local, s3://, hdfs://, ...)."""

    def __init__(self, path: str):
        self.store, self.base = store_of(path)

    def put(self, key: str, data: bytes) -> None:
        at = f"{self.base}/{key}"
        self.store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with self.store.open_output_stream(at) as f:
            f.write(data)

    def get(self, key: str) -> bytes:
        with self.store.open_input_file(f"{self.base}/{key}") as f:
            return f.read()

    def get_range(self, key: str, start: int, length: int) -> bytes:
        """Bytes [start, start + length); a range that isn't inside the object is an error."""
        with self.store.open_input_file(f"{self.base}/{key}") as f:
            if start < 0 or length < 0 or start + length > f.size():
                raise ValueError(f"invalid range {start}+{length} of {key} with {f.size()} bytes")
            return f.read_at(length, start)

    def size(self, key: str) -> int:
        with self.store.open_input_file(f"{self.base}/{key}") as f:
            return f.size()

    def delete(self, key: str) -> None:
        self.store.delete_file(f"{self.base}/{key}")

    def list(self, prefix: str = "") -> list[str]:
        """Keys that begin with the prefix, in order."""
        from pyarrow import fs

        info = self.store.get_file_info(fs.FileSelector(self.base, recursive=True, allow_not_found=True))
        keys = (f.path.removeprefix(self.base.rstrip("/") + "/") for f in info if f.is_file)
        return sorted(k for k in keys if k.startswith(prefix))
