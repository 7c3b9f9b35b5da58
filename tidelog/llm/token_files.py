"""Token-id files: fixed-width bit packing with block offsets.

Layout, little-endian: magic ``TLBP0001``; u32 width in bits; u32 ids a block; u64 ids; u64 documents; i64 doc_id of each
document; u8 whether that id is null; u64 end of each document (ids up to and with it); u64 byte offset of each block in the
payload, and its length; payload. Every id takes the bits that the vocabulary needs, lowest bit first; a block starts on a
byte, so id i is in block i // block and any range unpacks with numpy alone, without what lies before it.

Documents are dealt to tasks by range of doc_id and sorted there; a task tokenises and writes its files in turn, each of about
``file_ids`` ids and of whole documents, under a temporary name first; a task that runs again writes the same files anew. So
the files' names sort as their documents do, and ids before a file are sums over the list of files.

Files lie in the shared folder of spark.checkpoint.dir (any store that pyarrow.fs opens) and are read by Spark's binaryFile.

Defined cases: a null or empty text has the end id alone; null doc_ids come first; rows that repeat an id follow each other;
an empty table gives an empty result; only the id and the text of the input are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import work_dir, written
from tidelog.llm.word_bpe import word_coder

MAGIC, END, BLOCK, FILE_IDS = b"TLBP0001", 1, 65_536, 1_000_000
HEAD = struct.Struct("<8sIIQQ")


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, width: int) -> bytes:
    """ids (uint32) in width bits each, lowest bit first, filled up to a byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def file_bytes(doc_ids: list, ids: list[np.ndarray], width: int, block: int = BLOCK) -> bytes:
    """A file of documents in the order given."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [packed(flat[i : i + block], width) for i in range(0, len(flat), block)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    ends = np.cumsum([len(x) for x in ids], dtype="<u8")
    return b"".join([HEAD.pack(MAGIC, width, block, len(flat), len(doc_ids)), names.tobytes(), nulls.tobytes(), ends.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """A file's bytes, for random access."""

    def __init__(self, data: bytes):
        magic, self.width, self.block, self.n, docs = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.nulls = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
        self.ends = np.frombuffer(data, "<u8", docs, at := at + docs).astype(np.int64)
        blocks = -(-self.n // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * docs).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (blocks + 1) :]
        if len(self.payload) != self.offsets[-1]:
            raise ValueError("a token file is cut short")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file; only their blocks are unpacked."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        got = [unpacked(self.payload[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.n - b * self.block), self.width) for b in range(first, last + 1)]
        return np.concatenate(got)[start - first * self.block : stop - first * self.block]

    def documents(self):
        """(doc_id or None, start in the file, ids) of each document; each block is unpacked once."""
        start, low, high, held = 0, 0, 0, np.zeros(0, "<u4")  # held: ids [low, high), whole blocks
        for d, null, end in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.ends.tolist(), strict=True):
            if end > high:
                top = min(-(-end // self.block) * self.block, self.n)
                held = np.concatenate([held[start - low :], self.ids(high, top)])
                low, high = start, top
            yield None if null else d, start, held[start - low : end - low]
            start = end


def write_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files into folder; returns the written list of them: file, task, k, n_docs, n_ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        from pyarrow import RecordBatch, fs

        coder, task = word_coder(path), TaskContext.get().partitionId()
        attempt, width = TaskContext.get().taskAttemptId(), width_of(coder.vocabulary)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        tail, names, ids, n, k = np.array([end], "<u4"), [], [], 0, 0

        def close():
            name = f"tokens-{task:06d}-{k:05d}.bin"
            with store.open_output_stream(f"{base}/_{attempt}-{name}") as f:
                f.write(file_bytes(names, ids, width, block))
            store.move(f"{base}/_{attempt}-{name}", f"{base}/{name}")
            return RecordBatch.from_pydict({"file": [name], "task": [task], "k": [k], "n_docs": [len(names)], "n_ids": [n]})

        for batch in batches:
            for d, text in zip(batch.column(0), batch.column(1), strict=True):
                got = np.concatenate([np.frombuffer(coder.ids(text.as_py()), "<u4"), tail])
                if names and n + len(got) > file_ids:
                    yield close()
                    names, ids, n, k = [], [], 0, k + 1
                names.append(d.as_py())
                ids.append(got)
                n += len(got)
        if names:
            yield close()

    return written(rows.mapInArrow(run, "file string, task long, k long, n_docs long, n_ids long"))


def read_files(spark, folder: str, files: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (or ids_crc32 if digest) from the files."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                got = [(d, s, len(x), x) for d, s, x in TokenFile(data).documents()]
                out = pd.DataFrame({"file": name.rsplit("/", 1)[1], "doc_id": pd.array([g[0] for g in got], "Int64"), "at": [g[1] for g in got], "n_tokens": [g[2] for g in got]})
                last = [zlib.crc32(g[3].tobytes()) for g in got] if digest else [g[3].tolist() for g in got]
                yield out.assign(last=last)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(folder)
    docs = found.select("path", "content").mapInPandas(run, "file string, doc_id long, at long, n_tokens long, last " + ("long" if digest else "array<int>"))
    tasks = files.groupBy("task").agg(F.sum("n_ids").alias("all")).selectExpr("task", "sum(all) OVER (ORDER BY task) - all AS earlier")  # a row for each task
    before = files.selectExpr("file", "task", "sum(n_ids) OVER (PARTITION BY task ORDER BY k) - n_ids AS before").join(tasks, "task")
    return docs.join(before, "file").select("doc_id", (F.col("at") + F.col("before") + F.col("earlier")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if digest else "ids"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_dir(spark)
    files = write_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_files(spark, folder, files, digest=True)
