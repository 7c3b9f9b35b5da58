"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

Vectors are compared within their label by cosine in double precision. Equal vectors are first collapsed to one *representative*.

1. ITQ: on a bounded sample (``max_fit`` vectors, by a hash) the mean and principal axes are fitted, and rotations that minimise the
   quantisation error between the rotated vectors and their signs. Several rotations, from different starts, give a long code,
   one bit a dimension and rotation. Every vector is indexed, sampled or not.
2. Multi-index Hamming tables: the code is cut into substrings, one for each table; vectors that agree on one meet in a bucket. Each
   label has its own size of substrings, as many bits as it takes for buckets of about FILL, and as many tables as substrings of that
   size need: the sample tells how often two vectors at exactly the threshold agree on a substring, and the tables are so many
   that such a pair misses all of them with a probability of at most MISS. So the recall is the same for labels of any size.
   Labels of up to FILL vectors are one bucket.
3. Buckets first see ids and codes only: a vector stays in a bucket if another there is within the Hamming distance that pairs at the
   threshold keep to (the largest that the sample shows, and a margin), and their codes do not agree in an earlier table already.
   Then the vectors that are left are fetched.
4. What is left of a bucket is dealt into blocks; each pair of blocks is a cell, compared by one matrix product of the original
   vectors. A pair that meets in several tables counts in the first only, which both codes tell. A cell gives a count for each
   vector and the edges of a spanning forest of its links: rows grow with the vectors in it, not with their pairs.

Defined cases: null, empty or zero vectors, vectors with null or non-finite components, null labels and null ids link with nothing
(n_links 0, own component); vectors of different length never link; labels may be of any type that casts to text; an id that repeats
counts once for each of its rows, and each row is linked by its own vector; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import sampled, scratch, written
from tidelog.llm.components import components

THRESHOLD, BLOCK, FILL, MAX_FIT, ITERATIONS, SEED, MISS, PAIRS, LEAST_BITS, MOST_TABLES = 0.93, 256, 32, 20_000, 30, 11, 0.002, 4_000, 128, 256


class ITQ:
    """Mean, axes and rotations for vectors of one length; without vectors to fit, random rotations."""

    def __init__(self, x: np.ndarray, dim: int, bits: int, seed: int = SEED):
        rng = np.random.default_rng([seed, dim])
        self.mean, axes, self.x = np.zeros(dim), np.eye(dim), x[:PAIRS]
        if len(x) > 1:
            self.mean = x.mean(0)
            axes = np.linalg.svd((x - self.mean).T @ (x - self.mean))[0]
        v = (x - self.mean) @ axes
        maps = []
        for _ in range(-(-bits // dim)):
            r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            for _ in range(ITERATIONS if len(x) > 1 else 0):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            maps.append(axes @ r)
        self.map = np.concatenate(maps, axis=1)
        self.shift = self.mean @ self.map

    def bits(self, x: np.ndarray) -> np.ndarray:
        """The code bits of unit vectors x."""
        return x @ self.map >= self.shift

    def agreements(self, threshold: float) -> np.ndarray:
        """Which bits agree, for pairs at exactly the threshold: sampled vectors, each with one turned towards another."""
        rng, dim = np.random.default_rng(SEED), len(self.map)
        x = self.x if len(self.x) > 1 else unit(rng.normal(size=(PAIRS, dim)))
        y = x[rng.permutation(len(x))] + 1e-3 * rng.normal(size=x.shape)
        y -= (y * x).sum(1, keepdims=True) * x
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        return self.bits(x) == self.bits(threshold * x + math.sqrt(1 - threshold**2) * y)


def tables_for(agree: np.ndarray, size: int) -> int:
    """Tables of substrings of `size` bits after which at most MISS of the pairs have not met; agree: pairs x bits."""
    n = agree.shape[1] // size
    met = agree[:, : n * size].reshape(len(agree), n, size).all(2)
    missed = 1 - np.maximum.accumulate(met, axis=1).mean(0)
    enough = np.flatnonzero(missed <= MISS)
    if len(enough):
        return int(enough[0]) + 1
    return min(MOST_TABLES, math.ceil(math.log(MISS) / math.log(max(1e-9, 1 - met.mean()))))


def plan(reps: DataFrame, labels: list, threshold: float, max_fit: int) -> tuple[dict[int, ITQ], dict, dict[int, int]]:
    """Models by length of the vectors; size and tables by (dim, size of label as a power of two); Hamming limits by length."""
    rows = sum(r["n"] for r in labels)
    by_dim: dict[int, list] = {}
    for r in sampled(reps.select("v", "nid"), rows, max_fit, "nid").orderBy(F.xxhash64("nid")).collect():  # about max_fit rows
        by_dim.setdefault(len(r["v"]) // 8, []).append(np.frombuffer(r["v"], "<f8"))
    models, plans, limits = {}, {}, {}
    for dim in {r["dim"] for r in labels}:
        x = unit(np.array(by_dim[dim])) if dim in by_dim else np.zeros((0, dim))
        sizes = {b: min(dim, max(0, b - round(math.log2(FILL)))) for b in {r["b"] for r in labels if r["dim"] == dim}}
        most, bits = max(sizes.values()), LEAST_BITS
        while True:
            models[dim] = ITQ(x, dim, bits)
            agree = models[dim].agreements(threshold)
            tables = {b: tables_for(agree, s) if s else 1 for b, s in sizes.items()}
            needed = max((s * tables[b] for b, s in sizes.items()), default=0)
            if needed <= agree.shape[1]:
                break
            bits = needed
        differ = (~agree).sum(1)
        limits[dim] = int(differ.max() + 4 * differ.std()) if most else agree.shape[1]
        plans |= {(dim, b): (s, tables[b]) for b, s in sizes.items()}
    return models, plans, limits


def substrings(bits: np.ndarray, size: int, tables: int) -> np.ndarray:
    """The substrings of the codes as numbers, one column for each table."""
    if not size:
        return np.zeros((len(bits), 1), np.int64)
    return bits[:, : size * tables].reshape(len(bits), tables, size) @ (1 << np.arange(size, dtype=np.int64))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, v (components as 64-bit floats in a row), label (text), dim, ok."""
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"), F.col(label_col).cast("string").alias("label"))
    ok = "vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND NOT exists(x, c -> c IS NULL OR isnan(c) OR abs(c) = double('inf')) AND exists(x, c -> c <> 0)"

    def to_bytes(batches):
        for pdf in batches:
            yield pdf.assign(v=[np.asarray(x, "<f8").tobytes() if ok else None for x, ok in zip(pdf["x"], pdf["ok"], strict=True)], dim=pdf["x"].map(lambda x: 0 if x is None else len(x)))[["vec_id", "label", "ok", "v", "dim"]]

    return rows.withColumn("ok", F.coalesce(F.expr(ok), F.lit(False))).mapInPandas(to_bytes, "vec_id long, label string, ok boolean, v binary, dim int")


def apart(counted: np.ndarray, subs_x: np.ndarray, subs_y: np.ndarray, table: int) -> np.ndarray:
    """The pairs of counted (x against y) that do not agree in a table before this one."""
    i, j = np.nonzero(counted)
    if table and len(i):
        earlier = (subs_x[i, :table] == subs_y[j, :table]).any(1)
        counted[i[earlier], j[earlier]] = False
    return counted


def roots(hit: np.ndarray) -> np.ndarray:
    """For the symmetric relation hit the smallest place reachable from each."""
    label = np.arange(len(hit))
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], len(hit)).min(1))
        if (new == label).all():
            return label
        label = new


def cell_rows(table: int, i: int, j: int, nid: np.ndarray, mult: np.ndarray, own: np.ndarray, x: np.ndarray, subs: np.ndarray, threshold: float) -> list[tuple]:
    """(vector, null, links) and (vector, vector, 0) rows of a cell; x: unit vectors."""
    a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
    part = x[a] @ x[b].T >= threshold
    if i == j:
        np.fill_diagonal(part, False)
    if not part.any():
        return []
    counted = apart(part.copy(), subs[a], subs[b], table)
    n, hit = np.zeros(len(x), np.int64), np.zeros((len(x), len(x)), bool)
    n[a] = counted @ mult[b]
    if i != j:
        n[b] = counted.T @ mult[a]
    hit[np.ix_(a, b)] = part
    hit |= hit.T
    top = roots(hit)
    some, far = np.flatnonzero(n), np.flatnonzero(top != np.arange(len(top)))
    return [(r, None, k) for r, k in zip(nid[some].tolist(), n[some].tolist(), strict=True)] + [(int(nid[k]), int(nid[top[k]]), 0) for k in far]


def runs(batches, keys: list[str], work):
    """work(frame) for the rows of each key, which lie together; frames of several batches are joined."""
    left = None
    for pdf in batches:
        pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        starts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist()]
        yield [got for s, e in zip(starts, starts[1:]) for got in work(pdf.iloc[s:e])]
        left = pdf.iloc[starts[-1] :]
    if left is not None and len(left):
        yield list(work(left))


def dealt(rows: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, list[str]]:
    """Each row in the cells of its bucket: with i, j (blocks) and own (its block); buckets of one row go."""
    buckets = written(rows.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").withColumn("nb", F.expr(f"int(ceil(k / {block}))")).drop("k"))
    cells = rows.join(buckets, keys).withColumn("own", F.pmod(F.xxhash64("nid"), F.col("nb")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("nb", "other")
    keys = [*keys, "i", "j"]
    return cells.repartition(*keys).sortWithinPartitions(*keys), keys


def links(reps: DataFrame, threshold: float, block: int, max_fit: int) -> DataFrame:
    """(a, b null, n): n links of a; (a, b, 0): an edge. reps: nid, label, v, dim, mult."""
    power = F.expr("int(ceil(log2(n)))")
    of_label = written(reps.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("b", power))
    groups = of_label.groupBy("dim", "b").agg(F.sum("n").alias("n")).collect()  # a row for each length and power of two
    models, plans, limits = plan(reps, groups, threshold, max_fit)
    coded_in = reps.join(of_label.where("n > 1").select("label", "dim", "b"), ["label", "dim"]).select("nid", "label", "dim", "b", "v")

    def code(batches):
        for pdf in batches:
            for (dim, b), part in pdf.groupby(["dim", "b"]):
                bits = models[dim].bits(unit(np.frombuffer(b"".join(part["v"]), "<f8").reshape(-1, dim)))
                subs = substrings(bits, *plans[dim, b])
                yield part.drop(columns="v").assign(code=[x.tobytes() for x in np.packbits(bits, axis=1, bitorder="little")], subs=list(subs))

    coded = written(coded_in.mapInPandas(code, "nid long, label string, dim int, b int, code binary, subs array<long>"))
    entries = coded.select("nid", "label", "dim", "b", "code", F.posexplode("subs").alias("t", "sub"))
    cells, keys = dealt(entries, ["label", "dim", "t", "sub"], 2 * block)

    def close(frame):
        """Rows of a cell that have another within the Hamming limit which they don't meet in an earlier table."""
        dim, t, b = int(frame["dim"].iloc[0]), int(frame["t"].iloc[0]), int(frame["b"].iloc[0])
        size, tables = plans[dim, b]
        bits = np.unpackbits(np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), -1), axis=1, bitorder="little", count=models[dim].map.shape[1])
        subs, own = substrings(bits, size, tables), frame["own"].to_numpy()
        x, y = np.flatnonzero(own == frame["i"].iloc[0]), np.flatnonzero(own == frame["j"].iloc[0])
        signs = np.where(bits, np.float32(1), np.float32(-1))
        near = signs[x] @ signs[y].T >= bits.shape[1] - 2 * limits[dim]
        if frame["i"].iloc[0] == frame["j"].iloc[0]:
            np.fill_diagonal(near, False)
        near = apart(near, subs[x], subs[y], t)
        some = np.union1d(x[near.any(1)], y[near.any(0)])
        return [frame.iloc[some][["nid", "label", "dim", "b", "code", "t", "sub"]]] if len(some) else []

    def near(batches):
        for got in runs(batches, keys, close):
            if got:
                yield pd.concat(got)

    left = written(cells.mapInPandas(near, "nid long, label string, dim int, b int, code binary, t int, sub long").distinct())
    cells, keys = dealt(left.join(reps.select("nid", "v", "mult"), "nid"), ["label", "dim", "t", "sub"], block)

    def compare(frame):
        dim, t, b = int(frame["dim"].iloc[0]), int(frame["t"].iloc[0]), int(frame["b"].iloc[0])
        bits = np.unpackbits(np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), -1), axis=1, bitorder="little", count=models[dim].map.shape[1])
        x = unit(np.frombuffer(b"".join(frame["v"]), "<f8").reshape(-1, dim))
        return cell_rows(t, int(frame["i"].iloc[0]), int(frame["j"].iloc[0]), frame["nid"].to_numpy(), frame["mult"].to_numpy(), frame["own"].to_numpy(), x, substrings(bits, *plans[dim, b]), threshold)

    def run(batches):
        for out in runs(batches, keys, compare):
            yield pd.DataFrame({"a": pd.array([r[0] for r in out], "Int64"), "b": pd.array([r[1] for r in out], "Int64"), "n": pd.array([r[2] for r in out], "Int64")})

    return written(cells.mapInPandas(run, "a long, b long, n long"))


def embedding_dedup(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, max_fit: int = MAX_FIT) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    with scratch(table.sparkSession):
        rows = written(usable(table, id_col, vec_col, label_col), keep=True)
        good = rows.where("ok").drop("ok")
        reps = written(good.groupBy("label", "v", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).withColumn("nid", F.monotonically_increasing_id()))
        found = links(reps, threshold, block, max_fit)
        degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).toDF("nid", "n")
        parts = components(found.where("b is not null").select("a", "b")).toDF("nid", "part")
        joined = written(reps.join(degree, "nid", "left").join(parts, "nid", "left").select("label", "v", "rep", "part", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
        least = written(joined.where("part is not null").groupBy("part").agg(F.min("rep").alias("component")))
        of_rep = written(joined.join(least, "part", "left").select("label", "v", "n_links", F.coalesce("component", "rep").alias("component_id")), keep=True)
    linked = good.join(of_rep, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
