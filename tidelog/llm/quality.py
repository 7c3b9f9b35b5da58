"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled good; all texts that may be learned from, labelled or not, are the unlabelled mixture with
the share ``prior`` of good ones, so that it is there where every text has a label. A small network g is fitted in numpy to the non-negative unbiased risk

    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])

with the logistic loss l, so that sigmoid(g) estimates the probability of being good; where the second term turns negative in
a batch, the step goes against it. The prior is the share of good ones among the labels at hand (with add-one smoothing; 0.8
if there are none): labels of the other kind serve for nothing else.

Features are shape statistics of the whole text (letters, case, symbols, repetition of words and lines, lengths, compression),
the same for any language. They are written once, so texts are read a single time.

The fit uses at most about ``max_train`` positives and as many unlabelled texts, taken by a hash of their id and features at a
rate computed from their number. Defined cases: a null text is an empty one and gets a score like any other; labels without a document, and
null labels, count as none; of several labels for an id the largest holds; with no positives every score is the prior; an
empty table gives an empty result; only the id and the text of the documents are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import crc_mod, map_texts, sampled, written

MAX_TRAIN, HIDDEN, STEPS, BATCH, RATE, SEED, THRESHOLD = 20_000, 24, 1500, 1024, 0.01, 7, 0.3
SYMBOLS = re.compile(r"[^\w\s.,;:'\"()?-]")
ENDS = frozenset(".,;:?!")


def features(text: str) -> list[float]:
    """Shape statistics of a text; all zero for an empty one."""
    words, n = text.split(), len(text)
    if not words:
        return [0.0] * N_FEATURES
    w, lines = len(words), [x for x in text.split("\n") if x]
    raw = text.encode()
    kinds = np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=8)
    counts = Counter(words)
    top = max(counts.values())
    again = sum(a == b for a, b in zip(words, words[1:]))
    upper = sum(x.isupper() and len(x) > 1 for x in words)
    odd = len(SYMBOLS.findall(text))
    lengths = list(map(len, words))
    mean = sum(lengths) / w
    return [
        1.0,
        np.log1p(n),
        mean / 10,
        (sum(x * x for x in lengths) / w - mean * mean) ** 0.5 / 10,
        max(lengths) / 50,
        *(kinds / max(1, len(raw)) * 4).tolist(),
        odd / w,
        upper / w,
        text.count("!") / w,
        text.count("|") / w,
        sum(x[-1] in ENDS for x in words) / w,
        sum(x in {"|", "-", "*", "#"} for x in words) / w,
        len(counts) / w,
        top / w,
        again / w,
        1 - distinct_pairs(words, counts) / max(1, w - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(w / max(1, len(lines))) / 5,
        len(zlib.compress(raw, 1)) / len(raw),
        sum(x[0].isupper() for x in words) / w,
    ]


def distinct_pairs(words: list[str], counts: Counter) -> int:
    """How many different pairs of neighbours there are: 8 bytes a word, however long the text."""
    number = {x: i for i, x in enumerate(counts)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return len(np.unique(ids[:-1] << 32 | ids[1:]))


def kinds_of_bytes() -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 punctuation of prose, 6 other ASCII, 7 not ASCII."""
    out = np.full(256, 6, np.int64)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:'\"?-()")):
        out[[ord(c) for c in chars]] = k
    out[128:] = 7
    return out


KIND = kinds_of_bytes()
N_FEATURES = 27


class Net:
    """One hidden layer; g(x) as a number."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, weights: list[np.ndarray], prior: float):
        self.mean, self.std, self.weights, self.prior = mean, std, weights, prior

    def g(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.std @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.g(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Net | None:
    """Minimises the non-negative unbiased risk by Adam; None without positives or unlabelled texts."""
    if not len(positive) or not len(unlabelled):
        return None
    rng, both = np.random.default_rng(SEED), np.concatenate([positive, unlabelled])
    net = Net(both.mean(0), both.std(0) + 1e-6, [rng.normal(0, 0.3, (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)], prior)
    p, u = ((x - net.mean) / net.std for x in (positive, unlabelled))
    m, v = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        x, (w1, b1, w2, b2) = np.concatenate([xp, xu]), net.weights
        h = np.tanh(x @ w1 + b1)
        g = h @ w2 + b2[0]
        gp, gu = g[:BATCH], g[BATCH:]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        if negative >= 0:
            d = np.concatenate([prior * (sigmoid(gp) - 1) - prior * sigmoid(gp), sigmoid(gu)]) / BATCH
        else:
            d = np.concatenate([prior * sigmoid(gp), -sigmoid(gu)]) / BATCH
        back = d[:, None] * w2 * (1 - h * h)
        grads = [x.T @ back + 1e-4 * w1, back.sum(0), h.T @ d + 1e-4 * w2, np.array([d.sum()])]
        rate = RATE * (1 - step / (steps + 1))
        for i, gr in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr * gr
            net.weights[i] = net.weights[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return net


def some(df: DataFrame, most: int) -> np.ndarray:
    """Features of at most about `most` rows of df (doc_id, f), taken by a hash of both."""
    return np.array([r["f"] for r in sampled(df.select("doc_id", "f"), df.count(), most, "doc_id", "f").orderBy(F.xxhash64("doc_id", "f"), "doc_id").collect()], float).reshape(-1, N_FEATURES)


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f: the written features of every text."""
    made = map_texts(docs, id_col, text_col, lambda: lambda ids, texts: {"doc_id": ids, "f": [features(t) for t in texts]}, "doc_id long, f array<float>")
    return written(made)


def quality(docs: DataFrame, labels: DataFrame, may_learn, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, score, predicted. labels: doc_id, quality; may_learn(id column name): condition of rows to learn from."""
    table = featured(docs, id_col, text_col)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    train = written(table.where(may_learn("doc_id")).join(known, "doc_id", "left"))
    n = {r["quality"]: r["n"] for r in train.where("quality is not null").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    good, bad = n.get(1, 0), n.get(0, 0)
    prior = (good + 1) / (good + bad + 2) if bad else 0.8
    net = fit(some(train.where("quality = 1"), max_train), some(train, max_train), prior)

    def run(batches):
        for pdf in batches:
            score = net.score(np.stack(pdf["f"].to_numpy()).astype(float)) if net and len(pdf) else np.full(len(pdf), prior)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": score, "predicted": (score >= threshold).astype("int32")})

    return table.mapInPandas(run, "doc_id long, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = crc_mod("doc_id", 5) == 0
    return quality(docs, labels, lambda c: crc_mod(c, 5) != 0).select("doc_id", held.alias("held_out"), "score", "predicted")
