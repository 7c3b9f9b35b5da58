"""Language ID with hyperdimensional profiles.

Every letter has a random vector of -1 and 1 in ``DIM`` dimensions, made from its code point and a seed. An n-gram binds its
letters: the vector of the letter at place j is permuted (rolled) j times, and the vectors are multiplied. A text bundles the
vectors of all its n-grams, weighted by the square root of their counts so that a word repeated without end does not drown
the rest. The prototype of a language is the sum of the unit vectors of its training texts; a text gets the language with the
largest cosine, and that cosine, cut to 0..1, is its score.

Characters that aren't letters count as one blank, runs of blanks as one, and words are bound with the blanks around them.

Prototypes are fitted on at most about ``max_train`` texts: labelled rows are taken by a hash of id and text, at a rate computed
from their number, so the sample is spread over the table and has the same size however large that is. Each task sends one
partial sum per language. Prediction reads whole texts, in their tasks, without a shuffle.

Defined cases: a null, empty or letterless text is "und" with score 0; without any training text all are "und"; of equally
near languages the alphabetically first wins; other columns of the input are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import crc_mod, map_texts, sampled

DIM, GRAM, SEED, MAX_TRAIN = 512, 3, 20_240_229, 20_000
UNKNOWN = "und"
#: A task keeps the vectors of this many n-grams and starts over beyond it (DIM * 4 bytes each).
GRAMS_KEPT = 16_384


class Profiles:
    """Vectors of texts; the state of a task."""

    def __init__(self, dim: int = DIM, gram: int = GRAM, seed: int = SEED):
        self.dim, self.gram, self.seed = dim, gram, seed
        self.letters, self.n_letters = np.zeros((64, gram, dim), np.int8), 0
        self.of_code: dict[int, int] = {}
        self.table = np.full(0x110000, -1, np.int32)  # place in letters by code point; -1: not seen yet, -2: no letter
        self.place: dict[int, int] = {}
        self.grams = np.zeros((GRAMS_KEPT, dim), np.float32)
        self.add(32)

    def add(self, code: int) -> None:
        if code != 32 and not unicodedata.category(chr(code)).startswith("L"):
            self.table[code] = 0
            return
        one = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, np.int8) * np.int8(2) - np.int8(1)
        if self.n_letters == len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.letters[self.n_letters] = [np.roll(one, j) for j in range(self.gram)]
        self.table[code] = self.n_letters
        self.n_letters += 1

    def codes(self, text: str) -> np.ndarray:
        """Letters as places in the letter table, 0 for a blank, one blank at either end and between words."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        got = self.table[points]
        if got.size and got.min() < 0:
            for code in np.unique(points[got < 0]):
                self.add(int(code))
            got = self.table[points]
        got = np.concatenate([[0], got, [0]]).astype(np.int64)
        return got[np.concatenate([[True], (got[1:] != 0) | (got[:-1] != 0)])]

    def vector(self, text: str) -> np.ndarray | None:
        """The bundle of the text as a unit vector; None without letters. n_seen is then the number of its letters."""
        codes = self.codes(text)
        self.n_seen = int(np.count_nonzero(codes))
        if not self.n_seen:
            return None
        keys = np.zeros(len(codes) - self.gram + 1, np.int64) if len(codes) >= self.gram else np.zeros(0, np.int64)
        for j in range(self.gram):
            keys = keys << 20 | codes[j : len(codes) - self.gram + 1 + j]
        keys, counts = np.unique(keys, return_counts=True)
        out = self.bundle(keys, np.sqrt(counts, dtype=np.float32))
        norm = np.linalg.norm(out)
        return out / norm if norm else None

    def bundle(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dim, np.float32)
        for at in range(0, len(keys), GRAMS_KEPT):
            part = keys[at : at + GRAMS_KEPT]
            where = list(map(self.place.get, part.tolist()))
            if None in where:
                new = [k for k, w in zip(part.tolist(), where, strict=True) if w is None]
                if len(self.place) + len(new) > GRAMS_KEPT:
                    self.place.clear()
                    new = part.tolist()
                first = len(self.place)
                self.place.update(zip(new, range(first, first + len(new)), strict=True))
                self.grams[first : first + len(new)] = self.bound(np.array(new, np.int64))
                where = list(map(self.place.get, part.tolist()))
            out += weights[at : at + GRAMS_KEPT] @ self.grams[where]
        return out

    def bound(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of n-grams: the product of their letters' vectors, each rolled by its place."""
        out = np.ones((len(keys), self.dim), np.int8)
        for j in range(self.gram):
            out *= self.letters[(keys >> 20 * (self.gram - 1 - j)) & 0xFFFFF, j]
        return out.astype(np.float32)


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> dict[str, np.ndarray]:
    """Unit prototypes by language from the rows of train whose language is known."""
    labelled = train.where(F.col(lang_col).isNotNull())
    rows = labelled.select(id_col).count()
    if rows > max_train:
        labelled = sampled(labelled.select(id_col, text_col, lang_col), rows, max_train, id_col, text_col)

    def make():
        profiles, sums = Profiles(), {}

        def work(ids, texts, langs):
            for text, lang in zip(texts, langs, strict=True):
                v = profiles.vector(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)

        work.end = lambda: iter([{"lang": list(sums), "sums": [v.tolist() for v in sums.values()]}] if sums else [])
        return work

    parts = map_texts(labelled, id_col, text_col, make, "lang string, sums array<double>", (lang_col,))
    total = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    out = {}
    for lang, v in total.orderBy("lang").collect():  # DIM numbers a language
        x = np.array([e["x"] for e in v])
        out[lang] = (x / np.linalg.norm(x)).astype(np.float32)
    return out


def language_id(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", more: tuple[tuple[str, Column, str], ...] = ()) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, n_letters, and the columns more (name, expression over docs, type) passed through."""
    langs = sorted(prototypes)
    table = np.stack([prototypes[x] for x in langs]) if langs else None
    names = [n for n, _, _ in more]

    def make():
        profiles = Profiles()

        def one(text):
            v = profiles.vector(text)
            if v is None or table is None:
                return UNKNOWN, 0.0, profiles.n_seen
            cosines = table @ v
            best = int(cosines.argmax())
            return langs[best], float(min(1.0, max(0.0, cosines[best]))), profiles.n_seen

        def work(ids, texts, *others):
            got = [one(t) for t in texts]
            return {"doc_id": ids, "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "n_letters": [g[2] for g in got]} | {n: o for n, o in zip(names, others, strict=True)}

        return work

    schema = "doc_id long, lang_pred string, score double, n_letters long" + "".join(f", `{n}` {kind}" for n, _, kind in more)
    return map_texts(docs, id_col, text_col, make, schema, tuple(c for _, c, _ in more))


def unlike(found: DataFrame, least: int = 256, share: float = 0.5) -> DataFrame:
    """doc_id (not null) of texts in no language that was learned: those without letters, and those of `least` letters or more whose cosine
    is under `share` of the median cosine of learned texts of like length (the same power of two), as that of one word repeated, of
    noise, or of a language not learned is; shorter texts stay, as no cosine tells. found: language_id with a column learned."""
    found = found.withColumn("power", F.floor(F.log2(F.greatest("n_letters", F.lit(1)))))
    usual = found.where(f"learned AND n_letters >= {least}").groupBy("power").agg(F.percentile_approx("score", 0.5, 1000).alias("usual"))  # at most 63 rows
    bad = (F.col("lang_pred") == UNKNOWN) | ((F.col("n_letters") >= least) & (F.col("score") < share * F.col("usual")))
    return found.join(F.broadcast(usual), "power", "left").where(bad & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_mod("doc_id", 4) == 2
    return language_id(docs, fit(docs.where(~held)), more=(("held_out", held, "boolean"),)).select("doc_id", "held_out", "lang_pred", "score")
