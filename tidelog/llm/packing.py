"""Packing by shortest-pack-first over the length histogram.

Every text is tokenised in its task and cut into pieces of at most ``size`` tokens. Only the histogram of piece lengths (at most
``size`` numbers, whatever the input) reaches the driver. There lengths are placed longest first; a piece goes to the shortest
pack so far, that is the one with most space left, if it fits, else it opens a pack. Packs that look alike are one *pattern*
with a count, so placing all pieces of a length updates a few counts. What is left over in packs is then filled by cutting: the
packs with most space are dissolved, as many as fit into the spaces of over ``slack`` tokens in the others. Tokens of dissolved
pieces in a row, and such spaces in a row, are two lines of numbers; a piece is cut where its tokens pass from a space to the
next. So a pack has at most ``slack`` tokens of padding, but for less than ``size`` tokens in all.

A piece's rank among those of its length is its rank in its task plus the number in earlier tasks, so no length, however
frequent, meets in one task. Rank intervals of a length belong to a place in a pattern: a binary search in the (small) table
of intervals gives each piece its sequence and offset.

Defined cases: a null or empty text is one piece with the end id alone; rows that repeat are packed each; an empty table gives an
empty result; only the id and the text of the input are read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import map_texts, written
from tidelog.llm.word_bpe import word_coder

SIZE, END, SLACK = 4096, 2, 16


def patterns_of(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, number of such packs), from the number of pieces by length."""
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by space left
    spaces: list[int] = []  # heap of -space; may hold spaces that are used up

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        if space not in packs:
            packs[space] = []
            heapq.heappush(spaces, -space)
        packs[space].append((pattern, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while spaces and not packs.get(-spaces[0]):
                packs.pop(-heapq.heappop(spaces), None)
            space = -spaces[0] if spaces else 0
            if space < length:
                put(size - length, (length,), left)
                break
            pattern, n = packs[space].pop()
            used = min(n, left)
            if n > used:
                packs[space].append((pattern, n - used))
            put(space - length, (*pattern, length), used)
            left -= used
    return [x for space in sorted(packs) for x in packs[space]]


Patterns = list[tuple[tuple[int, ...], int]]


def dissolved(patterns: Patterns, size: int, slack: int) -> tuple[Patterns, Patterns]:
    """The patterns (from the least space to the most) in two parts, most space first: those that stay, those to cut."""
    spare = sum(n * (size - sum(p)) for p, n in patterns if size - sum(p) > slack)
    stay, cut, most = [], [], spare // size  # a pack less has its space and its tokens to make up for, together size
    for pattern, n in reversed(patterns):
        used = min(n, most)
        most -= used
        cut += [(pattern, used)] if used else []
        stay += [(pattern, n - used)] if n > used else []
    return stay, cut


def places_of(patterns: Patterns, cut: Patterns = ()) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) sorted by length and rank: where the pieces of a length go, by rank.
    Pieces of the patterns to cut have the sequence -1, and as offset their place in the line of such tokens."""
    ranks: dict[int, int] = {}
    rows, sequence, line = [], 0, 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, ranks.get(length, 0), sequence, offset))
            ranks[length] = ranks.get(length, 0) + n
            offset += length
        sequence += n
    for pattern, n in cut:
        for length in pattern:
            rows.append((length, ranks.get(length, 0), -1, line))
            ranks[length] = ranks.get(length, 0) + n
            line += n * length
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def spaces_of(patterns: Patterns, size: int, slack: int) -> np.ndarray:
    """Rows (place in the line of spaces, space, first sequence): the spaces of over slack tokens."""
    rows, sequence, line = [], 0, 0
    for pattern, n in patterns:
        space = size - sum(pattern)
        if space > slack:
            rows.append((line, space, sequence))
            line += n * space
        sequence += n
    return np.array(rows, np.int64).reshape(-1, 3)


def cuts_of(line: int, length: int, spaces: np.ndarray, size: int) -> list[tuple[int, int, int, int]]:
    """(start in the piece, length, sequence, offset) of the parts of a piece whose tokens begin at a place in the line."""
    out, at = [], 0
    while at < length:
        first, space, sequence = spaces[np.searchsorted(spaces[:, 0], line + at, "right") - 1].tolist()
        k, within = divmod(line + at - first, space)
        n = min(length - at, space - within)
        out.append((at, n, sequence + k, size - space + within))
        at += n
    return out


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, size: int, end: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian, 32 bits), task, rank (in the task, among pieces of that length)."""

    def make():
        coder, task, seen = word_coder(path), TaskContext.get().partitionId(), {}
        tail = np.array([end], "<u4").tobytes()

        def work(ids, texts):
            rows = []
            for i, text in zip(ids, texts, strict=True):
                data = coder.ids(text) + tail
                n = len(data) // 4
                for start in range(0, n, size):
                    part = data[4 * start : 4 * (start + size)]
                    length = len(part) // 4
                    rank = seen[length] = seen.get(length, -1) + 1
                    rows.append((i, start, length, zlib.crc32(part), n, part, task, rank))
            return dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "task", "rank"), zip(*rows, strict=True), strict=True)) if rows else None

        return work

    return map_texts(docs, id_col, text_col, make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, task long, rank long")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, with_ids: bool = False, slack: int = SLACK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids its ids (32-bit, little-endian)."""
    cut = written(pieces(docs, path, id_col, text_col, size, end))
    counts = written(cut.groupBy("length", "task").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    stay, gone = dissolved(patterns_of(histogram, size), size, slack)
    table, spaces = places_of(stay, gone), spaces_of(stay, size, slack)
    lengths, firsts, sequences, offsets = (table[:, i].copy() for i in range(4))
    keys = lengths << 48 | firsts
    whole = {}  # by length, the rank from which pieces are cut
    for length, first, sequence, _ in table.tolist():
        if sequence < 0:
            whole.setdefault(length, first)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    schema = docs.sparkSession.createDataFrame([], ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names)).schema

    def place(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            length, rank, start, crc = (batch.column(c).to_numpy() for c in ("length", "rank", "start", "ids_crc32"))
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            there, ids = sequences[at] >= 0, batch.column("ids")
            row = np.flatnonzero(there)
            a = at[row]
            parts = [np.stack([row, start[row], length[row], crc[row], sequences[a] + rank[row] - firsts[a], offsets[a]], axis=1)]
            data = [ids[i].as_py() for i in row.tolist()] if with_ids else []
            for i in np.flatnonzero(~there).tolist():
                text, line = ids[i].as_py(), int(offsets[at[i]] + (rank[i] - firsts[at[i]]) * length[i])
                for begin, n, sequence, offset in cuts_of(line, int(length[i]), spaces, size):
                    part = text[4 * begin : 4 * (begin + n)]
                    parts.append(np.array([[i, start[i] + begin, n, zlib.crc32(part), sequence, offset]], np.int64))
                    data.append(part)
            row, *made = np.concatenate(parts).T
            columns = dict(zip(("start", "length", "ids_crc32", "sequence_id", "offset"), made)) | {c: batch.column(c).take(pa.array(row)) for c in ("doc_id", "doc_tokens")} | {"ids": data}
            yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in out], schema=out)

    before = counts.selectExpr("length", "task", "sum(n) OVER (PARTITION BY length ORDER BY task) - n AS before")
    limits = F.broadcast(docs.sparkSession.createDataFrame(list(whole.items()), "length long, whole long"))  # at most `size` rows
    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before")).join(limits, "length", "left")
    ids = F.col("ids") if with_ids else F.when(F.col("rank") >= F.col("whole"), F.col("ids"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", ids.alias("ids")).mapInArrow(place, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
