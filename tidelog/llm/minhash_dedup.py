"""MinHash near-dedup: ProbMinHash signatures of shingle sets, banding, exact verification, components.

A text's elements are its distinct shingles of five words (A-Z lower-cased; all its words if fewer). Each element is a Poisson
process, of rate 1 however often the text repeats it: its arrivals come after exponential gaps and each falls on a random
register; a register keeps the element that arrives first. Two texts agree on a register with the probability of the Jaccard of
their shingle sets, the measure that links are verified by. Arrivals are followed only up to a time by which all registers are
likely filled, so most elements end after one draw; while a register is empty, that time doubles. Everything is a function of
the element alone.

1. Texts with the same shingle set are one *class representative* (smallest id) plus members; only representatives go on.
2. Signatures are cut into ``bands`` bands of ``rows`` registers: at similarity 0.8 a pair shares a bucket with probability
   1 - (1 - 0.8**4)**20 = 0.99997. Candidates come from buckets:
   a. of up to ``small`` members: all their pairs, a bounded number for each member;
   b. of more: each member with four hubs of its bucket, so rows grow with the members and not with their square. One hub is the
      member with the most company in large buckets, which in a group of copies is the text that they were made of;
   c. the rest, exactly: the members of large buckets that are not all connected by then meet in an exact similarity join
      (``rest_links``), which looks only for links between different components.
3. A candidate of a and b whose registers agree too rarely is left out (below ``floor``: 5 standard deviations under 0.8); the
   others are verified by the Jaccard of their shingle sets, read again from whole texts. Links join representatives to components.

Defined cases: texts without words (null, empty, punctuation only) are alone; rows with a null id link with nothing and get a
null class; an id that repeats counts each time in class_size; if its texts differ, each row is classed by its own text, and
texts that the same id represents are one class; an empty table gives an empty result; only the id and the text of the input are
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidelog.llm.common import kept_rows, map_texts, mix64, scratch, written
from tidelog.llm.components import components
from tidelog.llm.license_scan import words_of

SHINGLE, THRESHOLD, BANDS, ROWS, SMALL, HUBS, BLOCK, ROUNDS = 5, 0.8, 20, 4, 16, 4, 256, 2
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker remembers; the memory is emptied beyond it.
MEMORY = 300_000


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word.encode())
        return got


def shingles(text: str, hashes: Hashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the text."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = mix64(out * GOLD + h[j : len(h) - size + 1 + j])
    return np.unique(out)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash for n texts at once: uint32 fingerprints of the winners, n x m. owner: the text of each element, ascending."""
    best, won = np.full(n * m, np.inf), np.zeros(n * m, np.uint32)
    total = np.bincount(owner, weights, n)
    limit = (np.log(m) + 3) * m / np.maximum(total, 1e-300)  # by then all m registers are filled, for 19 texts in 20
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[owner])
        e, w, o, t = elements[live], weights[live], owner[live], np.zeros(len(live))
        step = 1
        while len(e):  # the step-th arrivals of elements whose last one came before the limit
            r = mix64(e + np.uint64(step * int(GOLD) & 0xFFFFFFFFFFFFFFFF))
            t = t - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / w
            there = t < limit[o]
            e, w, o, t = e[there], w[there], o[there], t[there]
            place = o * m + (mix64(r[there] ^ GOLD) % np.uint64(m)).astype(np.int64)
            order = np.argsort(-t, kind="stable")  # the earliest is written last
            place, arrival = place[order], t[order]
            better = arrival < best[place]
            place, arrival, first = place[better], arrival[better], e[order][better]
            best[place] = arrival
            won[place] = (first >> np.uint64(32)).astype(np.uint32)
            step += 1
        todo &= np.isinf(best.reshape(n, m)).any(1)
        limit[todo] *= 2
    return won.reshape(n, m)


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same / max(1, len(x) + len(y) - same)


def marked(docs: DataFrame, id_col: str, text_col: str, m: int) -> DataFrame:
    """doc_id, key (digest of the shingle set; null without words), sig."""

    def make():
        hashes = Hashes()

        def work(ids, texts):
            got = [shingles(t, hashes) for t in texts]
            sizes = [len(e) for e in got]
            sigs = signatures(np.concatenate(got), np.ones(sum(sizes)), np.repeat(np.arange(len(got)), sizes), len(got), m)
            keys = [hashlib.blake2b(e.tobytes(), digest_size=16).digest() if len(e) else None for e in got]
            return {"doc_id": ids, "key": keys, "sig": [s.tobytes() for s in sigs]}

        return work

    return map_texts(docs, id_col, text_col, make, "doc_id long, key binary, sig binary")


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, shingle set as sorted 64-bit hashes."""

    def make():
        hashes = Hashes()
        return lambda ids, texts: {"doc_id": ids, "hashes": [shingles(t, hashes).tobytes() for t in texts]}

    return map_texts(docs, id_col, text_col, make, "doc_id long, hashes binary")


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of registers on which two signatures agree."""
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(len(a), -1) for s in (a, b))
    return pd.Series((x == y).mean(1))


@F.pandas_udf(DoubleType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def links(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int, small: int) -> DataFrame:
    """(a, b) of verified representatives that connect all candidates over the threshold. reps: rep, sig."""
    floor = threshold - 5 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5
    cut = [F.xxhash64(F.lit(k), F.substring("sig", 4 * rows * k + 1, 4 * rows)) for k in range(bands)]
    entries = written(reps.select("rep", F.explode(F.array_distinct(F.array(*cut))).alias("bucket")))
    buckets = written(entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    few = entries.join(buckets.where(f"size <= {small}").select("bucket"), "bucket")
    pairs = pairs_within(few, "bucket", small)
    in_large = written(entries.join(buckets.where(f"size > {small}"), "bucket"))
    company = written(in_large.groupBy("rep").agg(F.sum("size").alias("company")))
    pairs = pairs.unionByName(spokes(in_large.select("bucket", "rep").join(company, "rep"), "bucket", "company")).distinct()
    sig_a, sig_b = reps.toDF("a", "sa"), reps.toDF("b", "sb")
    pairs = written(pairs.join(sig_a, "a").join(sig_b, "b").where(agreement("sa", "sb") >= floor).select("a", "b").distinct())
    wanted = written(pairs.select("a").union(pairs.select("b")).union(company.select("rep")).distinct())
    sets = written(sets_of(kept_rows(docs, id_col, wanted, "left_semi"), id_col, text_col).distinct())
    found = verified(pairs, sets, threshold)
    rest = unsettled(in_large, components(found))
    if rest.isEmpty():
        return found
    return found.unionByName(rest_links(rest, sets, threshold, small))


def pairs_within(rows: DataFrame, key: str, small: int) -> DataFrame:
    """(a, b) of the members of each key, which has at most `small` of them."""
    groups = rows.groupBy(key).agg(F.sort_array(F.collect_set("rep")).alias("r"))
    return groups.select(F.posexplode("r").alias("i", "a"), "r").select("a", F.explode(F.expr(f"slice(r, i + 2, {small})")).alias("b"))


def hubs_of(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """key, hubs: the member of the highest rank and some at random."""
    picks = [F.max_by("rep", F.struct(rank, "rep")), *(F.min_by("rep", F.xxhash64(F.lit(i), "rep")) for i in range(1, HUBS))]
    return rows.groupBy(key).agg(*(p.alias(f"hub{i}") for i, p in enumerate(picks))).select(key, F.array_distinct(F.array(*(f"hub{i}" for i in range(HUBS)))).alias("hubs"))


def spokes(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """(a, b): each member with the hubs of its key."""
    rows = rows.join(written(hubs_of(rows, key, rank)), key).select("rep", F.explode("hubs").alias("hub")).where("rep <> hub")
    return rows.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard of at least the threshold. sets: doc_id, hashes."""
    set_a, set_b = sets.toDF("a", "ha"), sets.toDF("b", "hb")
    return written(pairs.join(set_a, "a").join(set_b, "b").where(overlap("ha", "hb") >= threshold).select("a", "b").distinct())


def unsettled(in_large: DataFrame, parts: DataFrame) -> DataFrame:
    """rep, c (component) of the members of large buckets that hold several components."""
    own = written(in_large.select("bucket", "rep").join(parts.toDF("rep", "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep")))
    mixed = written(own.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket"))
    return written(own.join(mixed, "bucket").select("rep", "c").distinct())


def rest_links(rest: DataFrame, sets: DataFrame, threshold: float, small: int) -> DataFrame:
    """All links between different components c of the representatives rest (rep, c) that it takes to connect them.

    A link of x needs ceil(threshold * |x|) common shingles with a set of another component. So only shingles held by two
    components or more count; sets with too few of these have no link; and of the others, linked sets share one of their first
    count - ceil(threshold * |x|) + 1 such shingles, rarest first. A posting of such a shingle with at most `small` sets gives its
    pairs. In a longer one all are compared with hubs, the hubs leave it (all their pairs are decided), components are
    contracted and what holds one component only is done; after ROUNDS rounds blocks of it are compared (``blocked``)."""
    posts, found = written(postings(rest, sets, threshold)), None
    for turn in range(ROUNDS + 1):
        if posts.isEmpty():
            break
        size = written(posts.groupBy("e").agg(F.count("*").alias("size")))
        few, many = posts.join(size.where(f"size <= {small}"), "e"), written(posts.join(size.where(f"size > {small}"), "e").drop("size"))
        pairs = pairs_within(few, "e", small)
        if turn < ROUNDS:
            pairs = pairs.unionByName(spokes(many, "e", "shared"))
        ends = [rest.toDF(x, f"c{x}") for x in "ab"]
        pairs = pairs.distinct().join(ends[0], "a").join(ends[1], "b").where("ca <> cb").select("a", "b")
        new = verified(pairs, sets, threshold)
        if turn == ROUNDS and not many.isEmpty():
            new = new.unionByName(blocked(many.join(size, "e"), sets, threshold))
        found = new if found is None else found.unionByName(new)
        hubs = written(hubs_of(many, "e", "shared").select("e", F.explode("hubs").alias("rep")))
        posts = written(contracted(many.join(hubs, ["e", "rep"], "left_anti") if turn < ROUNDS else many.limit(0), rest, found))
    return found if found is not None else rest.select(F.col("rep").alias("a"), F.col("c").alias("b")).limit(0)


def contracted(posts: DataFrame, rest: DataFrame, found: DataFrame) -> DataFrame:
    """posts with the components that the links found so far give, without shingles of a single component."""
    own = rest.toDF("n", "c")
    joined = components(found.join(own.toDF("a", "ca"), "a").join(own.toDF("b", "cb"), "b").select("ca", "cb")).toDF("c", "new")
    posts = written(posts.join(joined, "c", "left").withColumn("c", F.coalesce("new", "c")).drop("new"))
    mixed = written(posts.groupBy("e").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("e"))
    return posts.join(mixed, "e")


def postings(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """e, rep, c, shared: the first shingles e of each set, as rest_links says; shared: the share of its shingles that count."""
    own = written(rest.join(sets, F.col("rep") == F.col("doc_id")).select("rep", "c", "hashes", F.xxhash64("hashes").alias("s")))

    def by_component(batches):
        """e, c and the number of sets; once for each batch."""
        for pdf in batches:
            for c, part in pdf.groupby("c"):
                e, n = np.unique(np.concatenate([np.frombuffer(h, np.int64) for h in part["hashes"]]), return_counts=True)
                yield pd.DataFrame({"e": e, "c": c, "n": n})

    def by_set(batches):
        for pdf in batches:
            e = [np.frombuffer(h, np.int64) for h in pdf["hashes"]]
            n = [len(x) for x in e]
            yield pd.DataFrame({"e": np.concatenate(e) if e else np.zeros(0, np.int64), "size": np.repeat(n, n), **{k: np.repeat(pdf[k].to_numpy(), n) for k in ("rep", "c", "s")}})

    common = own.select("c", "hashes").mapInPandas(by_component, "e long, c long, n long").groupBy("e").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.sum("n").alias("n")).where("low < high")
    each = own.mapInPandas(by_set, "e long, size long, rep long, c long, s long").join(written(common.select("e", "n")), "e")
    need = F.ceil(F.col("size") * F.lit(threshold) - 1e-9)
    enough = each.groupBy("rep", "c", "s", "size").agg(F.count("*").alias("shared"), F.sort_array(F.collect_list(F.struct("n", "e"))).alias("es")).where(F.col("shared") >= need)
    first = enough.select("rep", "c", (F.col("shared") / F.col("size")).alias("shared"), F.explode(F.slice("es", F.lit(1), (F.col("shared") - need + 1).cast("int"))).alias("x"))
    first = written(first.groupBy(F.col("x.e").alias("e"), "rep", "c").agg(F.max("shared").alias("shared")))
    mixed = written(first.groupBy("e").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("e"))
    return first.join(mixed, "e")


def blocked(posts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between components within each posting (of `size` sets), by pairs of blocks of about BLOCK sets; a pair of blocks gives a forest of them."""
    blocks = posts.withColumn("of", F.expr(f"int(ceil(size / {BLOCK}))")).withColumn("own", F.pmod(F.xxhash64("rep"), "of").cast("int"))
    cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select("e", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "c")
    cells = cells.join(sets, F.col("rep") == F.col("doc_id")).drop("doc_id")

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["own"] == pdf["i"]], pdf[pdf["own"] == pdf["j"]]
        out = []
        if len(a) and len(b):
            hit = close(a["hashes"].tolist(), b["hashes"].tolist(), threshold) & (a["c"].to_numpy()[:, None] != b["c"].to_numpy()[None, :])
            out = forest(a["rep"].tolist(), b["rep"].tolist(), a["c"].tolist(), b["c"].tolist(), hit)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return written(cells.groupBy("e", "i", "j").applyInPandas(cell, "a long, b long").distinct())


def close(a: list[bytes], b: list[bytes], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard of at least the threshold."""
    sets = [np.frombuffer(x, np.uint64) for x in a + b]
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    same = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        lo, hi = np.searchsorted(col, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[lo:hi], col[lo:hi] - low] = 1
        same += part[: len(a)] @ part[len(a) :].T
    either = sizes[: len(a), None] + sizes[None, len(a) :] - same
    return same / np.maximum(either, 1) >= threshold


def forest(a: list[int], b: list[int], ca: list[int], cb: list[int], hit: np.ndarray) -> list[tuple[int, int]]:
    """Of the links hit, as many as it takes to connect the components that they connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for i, j in zip(*np.nonzero(hit), strict=True):
        x, y = find(ca[i]), find(cb[j])
        if x != y:
            root[x] = y
            out.append((min(a[i], b[j]), max(a[i], b[j])))
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest id of its component), class_size (rows), kept (doc_id = class_id)."""
    with scratch(docs.sparkSession):
        return classes(docs, id_col, text_col, threshold, bands, rows, small)


def classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int, small: int) -> DataFrame:
    marks = written(marked(docs, id_col, text_col, bands * rows))
    known = marks.where("doc_id is not null and key is not null")
    reps = written(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")))
    found = links(docs.where(F.col(id_col).isNotNull()), reps.select("rep", "sig"), id_col, text_col, threshold, bands, rows, small)
    parts = components(found).toDF("rep", "part")
    class_of = written(reps.join(parts, "rep", "left").select("key", F.coalesce("part", "rep").alias("class_id")))
    own = marks.select("doc_id", "key").join(class_of, "key", "left").select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("class_id"))).alias("class_id"))
    own = written(own, keep=True)
    sizes = written(own.where("class_id is not null").groupBy("class_id").agg(F.count("*").alias("class_size")), keep=True)
    return own.join(sizes, "class_id", "left").select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.col("class_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_dedup keeps, all columns as they were."""
    dropped = written(near_dedup(docs, id_col, text_col).where("not kept").select("doc_id").distinct())
    return kept_rows(docs, id_col, dropped, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
