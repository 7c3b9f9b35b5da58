"""Byte-level BPE encoding and decoding with overlapping chunks.

A text is cut into chunks of ``chunk`` characters, each read with ``overlap`` characters on either side. Chunks are
pre-tokenised in parallel, from wherever they start. Pre-tokenisation has no memory beyond its place: two runs that share one
boundary share all later ones as far as both see the text that follows. So chunk k+1 takes over from chunk k at the first
boundary of the overlap at which both runs agree, with GUARD characters in sight behind it. If any overlap of a text has no
such place (a run of one kind over thousands of characters), that text is pre-tokenised in one go. Pieces are then encoded one
by one by the ranks, and decoding concatenates the bytes of the ids.

Texts of up to ``chunk`` characters are one chunk and never leave their task; only longer ones are dealt out by (id, chunk),
and only their ids meet again in one task, which is as large as one text.

Defined cases: a null or empty text has no ids and the digests of the empty string; repeated ids are kept apart by a row
number given before the cut; an empty table gives an empty result; only the id and the text of the input are read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import map_texts, written

CHUNK, OVERLAP, GUARD = 32_768, 2_048, 256
#: Pieces whose ids are remembered in a worker; the memory is emptied beyond it.
MEMORY = 200_000


class ByteBPE:
    """The public ranks and pattern: pieces of a text, ids of a piece, bytes of ids."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.find = regex.compile(pattern)
        self.bytes = {v: k for k, v in ranks.items()}.__getitem__
        self.known: dict[str, list[int]] = {}

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pieces of the text."""
        return [m.end() for m in self.find.finditer(text)]

    def ids(self, pieces: list[str]) -> list[int]:
        """Ids of pieces, each encoded separately."""
        known, out = self.known, []
        for p in pieces:
            got = known.get(p)
            if got is None:
                if len(known) >= MEMORY:
                    known.clear()
                got = known[p] = self.core.encode_single_piece(p.encode())
            out += got
        return out

    def encode(self, text: str) -> list[int]:
        return self.ids(self.find.findall(text))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes, ids))


@cache
def coder(ranks_path: str, pattern: str) -> ByteBPE:
    return ByteBPE(ranks_path, pattern)


def plain_ids(bpe: ByteBPE, ids: list[int]) -> tuple:
    """The default finish: the ids themselves."""
    return (ids,)


def digests(bpe: ByteBPE, ids: list[int]) -> tuple:
    """Number of ids, sha256 of the decimal ids joined by commas, sha256 of the decoded bytes."""
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", finish=plain_ids, columns: str = "ids array<int>", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: doc_id and the columns that finish(coder, ids) gives for the ids of the whole text."""
    if not GUARD < overlap <= chunk:
        raise ValueError("overlap must be over GUARD and at most chunk")
    schema = "doc_id long, " + columns
    names = [c.split()[0] for c in columns.split(", ")]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("n", F.length("text"))

    def short():
        bpe = coder(ranks_path, pattern)

        def work(ids, texts):
            got = [finish(bpe, bpe.encode(t)) for t in texts]
            return {"doc_id": ids} | {k: [g[i] for g in got] for i, k in enumerate(names)}

        return work

    whole = map_texts(rows.where(F.col("n") <= chunk), "doc_id", "text", short, schema)
    return whole.unionByName(stitched(rows.where(F.col("n") > chunk), ranks_path, pattern, finish, schema, names, chunk, overlap))


def stitched(rows: DataFrame, ranks_path: str, pattern: str, finish, schema: str, names: list[str], chunk: int, overlap: int) -> DataFrame:
    """byte_bpe for texts of several chunks; rows: doc_id, text, n."""
    def windows(batches):
        """A row per chunk, cut in one pass over its text; a text gives its windows in batches of some MB."""
        for pdf in batches:
            for doc_id, row, text in zip(pdf["doc_id"], pdf["row"], pdf["text"], strict=True):
                starts = range(0, len(text), chunk)
                for at in range(0, len(starts), 128):
                    got = [text[s : s + chunk + overlap] for s in starts[at : at + 128]]
                    yield pd.DataFrame({"doc_id": pd.array([doc_id] * len(got), "Int64"), "row": row, "n": len(text), "k": range(at, at + len(got)), "window": got})

    parts = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInPandas(windows, "doc_id long, row long, n int, k int, window string")
    parts = written(parts).repartition("row", "k")  # written, so that row numbers can't change when a lost task runs again

    def runs(batches):
        bpe = coder(ranks_path, pattern)
        for pdf in batches:
            heads, tails = [], []
            for n, k, window in zip(pdf["n"], pdf["k"], pdf["window"], strict=True):
                # a piece that ends near the edge of the window may go on behind it
                limit = len(window) if k * chunk + len(window) >= n else len(window) - GUARD
                ends = [e for e in bpe.boundaries(window) if e <= limit]
                heads.append([k * chunk + e for e in ends if e < overlap])
                tails.append([k * chunk + e for e in ends if chunk <= e])
            yield pdf.assign(head=heads, tail=tails)

    seen = parts.mapInPandas(runs, "doc_id long, row long, n int, k int, window string, head array<int>, tail array<int>")
    seen = written(seen)
    turn = "PARTITION BY row ORDER BY k"
    spans = seen.selectExpr("row", "k", "n", f"array_min(array_intersect(lag(tail) OVER ({turn}), head)) AS begin", f"array_min(array_intersect(tail, lead(head) OVER ({turn}))) AS stop", "count(*) OVER (PARTITION BY row) AS parts")
    spans = spans.selectExpr("row AS r", "k AS j", "IF(k = 0, 0, begin) AS begin", "IF(k = parts - 1, n, stop) AS stop", "parts")
    whole = spans.groupBy("r").agg(F.bool_or(F.expr("begin IS NULL OR stop IS NULL OR begin > stop")).alias("lost"))
    pieces = seen.join(spans, (F.col("row") == F.col("r")) & (F.col("k") == F.col("j"))).drop("r", "head", "tail").join(whole, F.col("row") == F.col("r")).drop("r", "j")

    def encode(batches):
        bpe = coder(ranks_path, pattern)
        for pdf in batches:
            ids = []
            for k, window, begin, stop, lost in zip(pdf["k"], pdf["window"], pdf["begin"], pdf["stop"], pdf["lost"], strict=True):
                text = window[:chunk].encode() if lost else np.asarray(bpe.encode(window[int(begin) - k * chunk : int(stop) - k * chunk]), "<u4").tobytes()
                ids.append(text)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row": pdf["row"], "k": pdf["k"], "lost": pdf["lost"], "ids": ids})

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        bpe = coder(ranks_path, pattern)
        data = b"".join(pdf.sort_values("k")["ids"])
        ids = bpe.encode(data.decode()) if pdf["lost"].iloc[0] else np.frombuffer(data, "<u4").tolist()
        return pd.DataFrame([(pdf["doc_id"].iloc[0], *finish(bpe, ids))], columns=["doc_id", *names])

    coded = pieces.mapInPandas(encode, "doc_id long, row long, k int, lost boolean, ids binary")
    return coded.groupBy("row").applyInPandas(together, schema)


def decode(coded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and bytes: the concatenated bytes of the ids; null ids give empty bytes."""

    def run(batches):
        bpe = coder(ranks_path, pattern)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "bytes": [bpe.decode([] if i is None else list(i)) for i in pdf["ids"]]})

    return coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id long, bytes binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, finish=digests, columns="n_tokens long, ids_sha256 string, decoded_sha256 string")
