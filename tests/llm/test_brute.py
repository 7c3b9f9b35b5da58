"""The operators against plain versions on small inputs."""

import hashlib
import inspect
import math
import random
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import attention_lm, byte_bpe, embedding_dedup, language_id, license_scan, lm_scoring, minhash_dedup, packing, quality, token_files
from tidelog.llm.common import crc_mod
from tidelog.llm.components import components
from tidelog.llm.language_id import query as language_query
from tidelog.llm.word_bpe import WordBPE

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CHARS = "abcABC'sdrelmtv .,!?0159\t\n\x0b\x0c\r\x1c\u0085  éÉ́ßΣσİ中文\U0001f600<|endoftext|>_-×÷ÿ"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


PARTS = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "a", "é", "<|", "|>", "hello"]), max_size=8).map("".join)


@given(st.text(CHARS, max_size=40) | st.text(max_size=20) | PARTS)
@settings(max_examples=600)
def test_word_ids_equal_the_library(text):
    coder, library = test_word_ids_equal_the_library.coders
    assert np.frombuffer(coder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


test_word_ids_equal_the_library.coders = WordBPE(WORDS), Tokenizer.from_file(WORDS)


def encoding():
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_chunks_equal_the_library(spark):
    rnd, enc = random.Random(5), encoding()
    texts = ["".join(rnd.choices(CHARS + "abc   \n", k=rnd.randint(0, 9000))) for _ in range(12)] + ["a" * 5000, " " * 5000, "word " * 2000, "x" * 700 + " " * 900 + "y" * 3000, "\n \n" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = byte_bpe.byte_bpe(df, RANKS, public_tokenizers.PATTERN, chunk=1024, overlap=512)
    got = {r["doc_id"]: list(r["ids"]) for r in coded.collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
    back = {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: t.encode() for i, t in enumerate(texts)}


def test_byte_bpe_query(spark, sf, docs):
    enc = encoding()
    for r in byte_bpe.query(spark, sf).collect():
        ids = enc.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())


def test_license_query(spark, sf, docs):
    got = {r["doc_id"]: r for r in license_scan.query(spark, sf).collect()}
    assert set(got) == set(docs)
    for d, text in docs.items():
        w = license_scan.words_of(text)
        at = sorted((i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert {*r["base_labels"].split(",")} - {""} <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1


def test_language_held_out(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = language_query(spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def shingle_sets(texts):
    out = {}
    for i, t in texts.items():
        w = license_scan.words_of(t)
        out[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def near_classes(texts):
    sets, root = shingle_sets(texts), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shared, where = Counter(), defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for v in where.values():
        shared.update((a, b) for k, a in enumerate(v) for b in v[k + 1 :])
    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_near_dedup_equals_all_pairs(spark, sf, docs):
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.query(spark, sf).collect()}
    assert got == near_classes(docs)


def test_near_dedup_in_a_large_group_without_a_centre(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(250):
        w = list(base)
        for _ in range(rnd.randint(0, 14)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        texts[i] = " ".join(w)
    texts |= {1000 + i: " ".join(f"c{i}-{j}" for j in range(50)) for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_dedup(df).collect()} == near_classes(texts)


def test_near_dedup_links_texts_that_differ_by_repeats(spark):
    texts = {}
    for k, (n, times) in enumerate([(200, 10), (500, 30), (200, 3), (300, 100)] * 5):
        w = [f"w{k}-{i}" for i in range(n)]
        texts |= {10 * k: " ".join(w), 10 * k + 1: " ".join(w[:50] * times + w), 10 * k + 2: " ".join(f"o{k}-{i}" for i in range(n)) + " " + " ".join(w[:50] * times)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = near_classes(texts)
    assert len(set(want.values())) == 40 and {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_dedup(df).collect()} == want


def test_signatures_estimate_the_probability_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = {int(x): int(w) for x, w in zip(e[:220], rng.integers(1, 4, 220))}, {int(x): int(w) for x, w in zip(e[80:], rng.integers(1, 4, 220))}
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in a if i in b)
    m = 4000
    x = np.concatenate([np.array(sorted(d), np.uint64) for d in (a, b)])
    w = np.concatenate([np.array([d[k] for k in sorted(d)], float) for d in (a, b)])
    s = minhash_dedup.signatures(x, w, np.repeat([0, 1], [len(a), len(b)]), 2, m)
    assert abs((s[0] == s[1]).mean() - exact) < 4 * (exact * (1 - exact) / m) ** 0.5
    alone = minhash_dedup.signatures(x[: len(a)], w[: len(a)], np.zeros(len(a), int), 1, m)
    assert (alone[0] == s[0]).all()


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def all_links(ids, vectors, labels):
    """n_links and component of each vector, by all pairs."""
    y = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hit = (y @ y.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(hit, False)
    top = embedding_dedup.roots(hit)
    return {i: (int(n), ids[t]) for i, n, t in zip(ids, hit.sum(1), top)}


def test_embedding_query_equals_all_pairs(spark, tmp_path):
    rows = sorted((r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect())
    rng, rows = np.random.default_rng(1), [r for r in rows if r[1] is not None and r[2] is not None and any(r[1])]
    for i, v, label in rows[::3]:
        near = np.array(v) + rng.normal(size=len(v)) * np.linalg.norm(v) / len(v) ** 0.5 * rng.choice([0.1, 0.3, 0.4])
        rows = [*rows, (10**6 + i, near.astype(np.float32).tolist(), label)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = all_links([r[0] for r in rows], np.array([r[1] for r in rows], np.float32).astype(float), [r[2] for r in rows])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.query(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values()) > 0
    assert all(got[i][0] <= want[i][0] for i in got) and sum(got[i] == want[i] for i in got) >= 0.98 * len(got)


def test_embedding_labels_of_very_different_size(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(900, 32))
    x = np.concatenate([centres[k] + rng.normal(size=(rng.choice([1, 2, 4]), 32)) * rng.choice([0.1, 0.2, 0.25]) for k in range(900)])
    x = np.concatenate([x, rng.normal(size=(200, 32)), x[:3]])
    labels = ["huge" if i < len(x) - 203 else f"tiny{i % 150}" for i in range(len(x) - 3)] + ["huge"] * 3
    df = spark.createDataFrame([(i, v.tolist(), label) for i, (v, label) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label string")
    want = all_links(list(range(len(x))), x, labels)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(df, block=64).collect()}
    assert all(got[i][0] <= want[i][0] for i in got) and sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values()) > 0
    assert sum(got[i] == want[i] for i in got) >= 0.98 * len(got)


@pytest.mark.parametrize("size", [4, 10, 16])
def test_tables_find_pairs_at_the_threshold_at_any_size(size):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6000, 64)) @ rng.normal(size=(64, 64)) * 0.3 + rng.normal(size=64)
    fitted, fresh = embedding_dedup.unit(base[:3000]), embedding_dedup.unit(base[3000:])
    bits = 64
    while True:
        model = embedding_dedup.ITQ(fitted, 64, bits)
        tables = embedding_dedup.tables_for(model.agreements(0.93), size)
        if tables * size <= model.map.shape[1]:
            break
        bits = tables * size
    u = rng.normal(size=fresh.shape)
    u -= (u * fresh).sum(1, keepdims=True) * fresh
    near = 0.93 * fresh + math.sqrt(1 - 0.93**2) * embedding_dedup.unit(u)
    a, b = (embedding_dedup.substrings(model.bits(v), size, tables) for v in (fresh, near))
    assert (a == b).any(1).mean() >= 0.98


def test_packing(spark, sf, docs):
    coder = WordBPE(WORDS)
    rows = packing.query(spark, sf).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs) and sorted(sequences) == list(range(len(sequences)))
    for d, text in docs.items():
        ids, at = np.append(np.frombuffer(coder.ids(text), "<u4"), 2).astype("<u4"), 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.SIZE


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_hold_every_piece_once(histogram):
    patterns = packing.patterns_of(histogram, 64)
    got = Counter()
    for p, n in patterns:
        assert sum(p) <= 64 and n > 0
        for x in p:
            got[x] += n
    assert got == Counter(histogram)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20), st.integers(0, 8))
def test_cutting_leaves_little_padding(histogram, slack):
    stay, cut = packing.dissolved(packing.patterns_of(histogram, 64), 64, slack)
    spaces, filled, placed = packing.spaces_of(stay, 64, slack), defaultdict(list), Counter()
    table = packing.places_of(stay, cut).tolist()
    for k, (length, first, sequence, at) in enumerate(table):
        last = table[k + 1][1] if k + 1 < len(table) and table[k + 1][0] == length else histogram[length]
        for rank in range(first, last):
            placed[length] += 1
            got = [(0, length, sequence + rank - first, at)] if sequence >= 0 else packing.cuts_of(at + (rank - first) * length, length, spaces, 64)
            assert sum(n for _, n, _, _ in got) == length
            for _, n, s, offset in got:
                filled[s].append((offset, n))
    assert placed == Counter(histogram) and sorted(filled) == list(range(sum(n for _, n in stay)))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(k * n for k, n in histogram.items())
    assert 64 * len(filled) - total < slack * len(filled) + 64


def test_packing_of_one_dominant_length(spark):
    texts = {i: "a " * (2099 if i % 3 else 3 + 97 * i) for i in range(60)} | {100: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows, coder = packing.pack(df, WORDS, with_ids=True).collect(), WordBPE(WORDS)
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]][r["start"]] = bytes(r["ids"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        assert b"".join(pieces[i][k] for k in sorted(pieces[i])) == bytes(coder.ids(t or "")) + b"\2\0\0\0"
    assert sorted(sequences) == list(range(len(sequences))) and len({(s, o) for s, x in sequences.items() for o, _ in x}) == len(rows)
    assert all(sum(n for _, n in x) <= packing.SIZE for x in sequences.values())
    tokens = sum(r["length"] for r in rows)
    assert packing.SIZE * len(sequences) - tokens < packing.SLACK * len(sequences) + packing.SIZE
    plain = {tuple(r[c] for c in ("doc_id", "start", "ids_crc32", "sequence_id", "offset")) for r in packing.pack(df, WORDS).collect()}
    assert plain == {tuple(r[c] for c in ("doc_id", "start", "ids_crc32", "sequence_id", "offset")) for r in rows}


@given(st.integers(1, 32), st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=8), st.integers(1, 30))
def test_token_file_round_trip(width, texts, block):
    texts = [[i & (1 << width) - 1 for i in t] for t in texts]
    names = [None if i % 3 == 0 else i for i in range(len(texts))]
    f = token_files.TokenFile(token_files.file_bytes(names, [np.array(t, np.uint32) for t in texts], width, block))
    flat = [i for t in texts for i in t]
    assert [(d, x.tolist()) for d, _, x in f.documents()] == list(zip(names, texts))
    assert f.ids(len(flat) // 3, len(flat) // 2).tolist() == flat[len(flat) // 3 : len(flat) // 2]


def test_token_files_query(spark, sf, docs):
    coder, start = WordBPE(WORDS), 0
    for r in sorted(token_files.query(spark, sf).collect(), key=lambda r: r["doc_id"]):
        ids = np.append(np.frombuffer(coder.ids(docs[r["doc_id"]]), "<u4"), 1).astype("<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    with pytest.raises(ValueError):
        token_files.TokenFile(b"x" * 40)


def test_lm_base_scores_and_model(spark, sf, docs):
    words = {d: t.encode().lower().split() + [b""] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    got = lm_scoring.query(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0


def test_lm_scores_mix_in_the_counts_of_all_training_texts(spark, sf, docs, monkeypatch):
    coder, held = WordBPE(WORDS), {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    end = coder.vocabulary - 1
    ids = {d: [i for w in t.encode().lower().split() for i in np.frombuffer(coder.ids(w.decode()), "<u4").tolist()] + [end] for d, t in docs.items()}
    c = Counter(p for d, x in ids.items() if not held[d] for p in zip([end, *x], x))
    n, t, one = Counter(), Counter(a for a, _ in c), Counter(i for d, x in ids.items() if not held[d] for i in x)
    for (a, _), k in c.items():
        n[a] += k
    model = attention_lm.Model(np.array([one[i] for i in range(coder.vocabulary)], float))  # untrained
    table = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    got = lm_scoring.lm_scores(table, WORDS, crc_mod("doc_id", 5) == 1, max_train=0, every=10**12).collect()
    score = lambda x, *levels: model.scores(np.array(x), np.array([len(x)]), end, levels=levels)[0]
    pairs = lambda x: lambda here: tuple(np.array(col, float) for col in zip(*((c[p], n[p[0]], max(1, t[p[0]])) for p in list(zip([end, *x], x))[here])))
    monkeypatch.setattr(lm_scoring, "SOME", 1)  # in the driver only: the query below runs with the counted share
    kept, long = lambda x: lm_scoring.long_contexts(np.array([*x, 0]), np.zeros(len(x) + 1, int), np.array([len(x) + 1]), 1), {}
    for d, x in ids.items():
        row = [end, *x]
        places, _, contexts, *_ = kept(row[:-1])
        long[d] = {i: (tuple(row[i - 3 : i + 1]), x[i]) for i, g in zip(places.tolist(), contexts.tolist()) if g % 16 == 0 and i < len(x)}
    monkeypatch.undo()
    every = Counter(k for d, x in long.items() if not held[d] for k in x.values())
    assert len(got) == len(docs) and sum(map(len, long.values())) > 1000

    for r in got:
        d = r["doc_id"]
        own = Counter() if held[d] else Counter(long[d].values())
        left = {k: every[k] - own[k] for k in {*long[d].values()}}
        contexts = {k[0] for k in left}
        after = {g: Counter({k: every[k] - own[k] for k in every if k[0] == g and every[k] > own[k]}) for g in contexts} if d % 7 == 0 else None

        if after is not None:
            c4, n4, t4 = (np.full(len(ids[d]), x, float) for x in (0, 0, 1))
            for i, k in long[d].items():
                c4[i], n4[i], t4[i] = left[k], sum(after[k[0]].values()), max(1, len(after[k[0]]))
            want = score(ids[d], pairs(ids[d]), lambda here, x=(c4, n4, t4): [y[here] for y in x])
            assert math.isclose(r["score"], want, rel_tol=1e-4) and r["score"] > score(ids[d])
    assert math.isclose(sum(10 ** score([i], pairs([i])) for i in range(0, coder.vocabulary)), 1, rel_tol=1e-3)


def test_lm_query_counts_every_long_context(spark, tmp_path):
    """Of a text that occurs twice every id after the first few is known from the other one, not one of some."""
    rng = np.random.default_rng(5)
    once = {i: " ".join(map(str, rng.integers(10**5, 10**6, 60))) for i in range(40)}
    train = [i for i in once if zlib.crc32(str(i).encode()) % 5 != 1]
    twice = {**once, train[1]: once[train[0]]}
    spark.createDataFrame(sorted(twice.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] / (7 * 60 + 1) for r in lm_scoring.query(spark, str(tmp_path)).collect()}
    copies = [got.pop(i) for i in train[:2]]
    assert math.isclose(*copies, rel_tol=1e-6) and copies[0] > -0.4 and max(got.values()) < -0.6


@given(st.lists(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=30), min_size=1, max_size=4), min_size=1, max_size=3), st.integers(0, 2**12), st.integers(1, 5))
def test_lm_long_counts_equal_dictionaries(chunks, which, shards):
    """c, n, t of all places with a context of four ids, each training text's own part left out; over chunks and shards."""
    helds, at, laid = [], 0, []
    for texts in chunks:
        helds.append(np.array([which >> (at + i) & 1 == 1 for i in range(len(texts))]))
        at += len(texts)
        laid.append(attention_lm.laid_out(texts))
    sent = [lm_scoring.of_long(t, n, h, 9, shards, 1) for (t, n), h in zip(laid, helds, strict=True)]
    back = [{} for _ in chunks]
    for k in {k for x in sent for k in x}:
        there = [i for i, x in enumerate(sent) if k in x]
        for i, data in zip(there, lm_scoring.long_sums([sent[i][k] for i in there]), strict=True):
            back[i][k] = data
    rows = lambda x: [(tuple([9, *x][i - 3 : i + 1]), x[i]) for i in range(3, len(x))]
    all_rows = [(j, i, r) for j, texts in enumerate(chunks) for i, x in enumerate(texts) if not helds[j][i] for r in rows(x)]
    for j, texts in enumerate(chunks):
        targets, lengths = laid[j]
        found = lm_scoring.long_contexts(attention_lm.inputs(targets, lengths, 9), targets, lengths, shards, 1)
        counts = np.concatenate([np.zeros((3, 0), np.int64), *(lm_scoring.long_counts(back[j][k]) for k in sorted(back[j]))], axis=1)
        got = np.stack(lm_scoring.long_levels(found, len(targets), helds[j], counts), axis=1)
        want = []
        for i, x in enumerate(texts):
            rest = Counter(r for b, a, r in all_rows if (b, a) != (j, i))
            after = {g: [k for k in rest if k[0] == g] for g, _ in rows(x)}
            want += [(0, 0, 1)] * min(3, len(x)) + [(rest[r], sum(rest[k] for k in after[r[0]]), max(1, len(after[r[0]]))) for r in rows(x)]
        assert got.tolist() == [list(map(float, w)) for w in want]


def test_lm_sends_each_long_context_in_one_of_several_rounds(spark, sf, monkeypatch):
    """No shuffle holds all long contexts, the rounds together do, and of the shuffles nothing lies on disk when the query returns."""
    def on_disk():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p.name for d in dirs for p in Path(str(d)).glob("*/shuffle_*.data")}

    rng, seen, before = np.random.default_rng(3), [], on_disk()
    table = lm_scoring.long_table
    monkeypatch.setattr(lm_scoring, "long_table", lambda *x: seen.append(x) or table(*x))
    df = lm_scoring.query(spark, sf)
    for _ in range(50):  # files go shortly after their action
        if on_disk() - before:
            time.sleep(0.1)
    assert not on_disk() - before
    assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    targets, lengths = attention_lm.laid_out([rng.integers(0, 9, 5000)])
    shards, within = seen[0][2], [x[4] for x in seen]
    send = lambda *w: lm_scoring.of_long(targets, lengths, np.array([False]), 9, shards, 1, *w)
    every, parts = send(), [send(w) for w in within]
    assert len(parts) > 1 and sum(map(len, parts)) == len(every) == len({k for p in parts for k in p}) and {k: v for p in parts for k, v in p.items()} == every
    assert max(sum(map(len, p.values())) for p in parts) < 0.5 * sum(map(len, every.values()))


@pytest.mark.parametrize("bits", [30, 48, 56, 64])
def test_lm_order_of_contexts_is_by_context_id_and_place(bits):
    rng = np.random.default_rng(bits)
    contexts, ids = (rng.integers(0, 40, 3000).astype(np.uint64) << np.uint64(bits - 6)) + np.uint64(7), rng.integers(0, 50_000, 3000) // 1000 * 1000
    assert lm_scoring.ordered(contexts, ids).tolist() == np.lexsort((np.arange(3000), ids, contexts)).tolist()
    assert lm_scoring.ordered(contexts[:0], ids[:0]).tolist() == []


def test_lm_is_trained_on_every_window_of_the_training_texts():
    assert inspect.signature(lm_scoring.lm_scores).parameters["every"].default == 1
    lengths, held = np.array([1, 24, 25, 3000, 100]), np.array([False, False, True, False, False])
    targets = np.arange(lengths.sum())
    got = np.concatenate([t[v] for _, _, t, v in lm_scoring.windows(targets, lengths, held, 9, 1, 7)])
    assert sorted(got.tolist()) == targets[np.repeat(~held, lengths)].tolist()


def test_attention_model_is_causal_normalised_and_learns():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 50, 300)
    model = attention_lm.Model(counts)
    assert np.allclose(np.bincount(model.classes, np.exp(model.share)), 1)
    texts = [np.tile(np.arange(1, 8), 12)[: rng.integers(1, 80)] for _ in range(40)]
    scores = lambda ts, **k: model.scores(*attention_lm.laid_out(ts), 0, **k)
    one = [scores([t])[0] for t in texts]
    assert np.allclose(scores(texts, batch=7), one, rtol=1e-4)
    total = sum(10 ** scores([np.array([3, i])])[0] for i in range(300))  # over all second ids: the probability of the first
    assert math.isclose(total, 10 ** scores([np.array([3])])[0], rel_tol=1e-3)
    before = scores(texts).sum()
    model.fit(texts, 0, steps=60)
    assert scores(texts).sum() > before / 2


def test_fast_hidden_layer_equals_the_plain_one():
    rng = np.random.default_rng(6)
    model = attention_lm.Model(rng.integers(1, 50, 300))
    texts = [rng.integers(0, 300, n) for n in (1, 3, 24, 25, 60, 200)]
    targets, lengths = attention_lm.laid_out(texts)
    owner, first = attention_lm.windows_of(lengths)
    ids, known, _, valid = attention_lm.view(attention_lm.inputs(targets, lengths, 0), np.cumsum(lengths) - lengths, lengths, owner, first)
    plain = model.forward(ids, known)[0].reshape(-1, attention_lm.HIDDEN)
    assert np.allclose(model.hidden(ids, known)[valid.ravel()], plain[valid.ravel()], atol=1e-5)


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = attention_lm.Model(rng.integers(1, 9, 40))
    model.w = {k: w.astype(np.float64) for k, w in model.w.items()}
    ids, known = rng.integers(0, 40, (3, attention_lm.WINDOW)), np.ones((3, attention_lm.WINDOW), bool)
    known[0, :30] = False
    goals, valid = rng.integers(0, 30, (3, attention_lm.STRIDE)), np.ones((3, attention_lm.STRIDE), bool)
    _, d = model.step(ids, known, goals, valid)
    for name in ("P", "Q", "K", "V", "O", "H", "U", "C"):
        at = np.unravel_index(np.abs(d[name]).argmax(), d[name].shape)
        model.w[name][at] += 1e-5
        up = model.step(ids, known, goals, valid)[0]
        model.w[name][at] -= 2e-5
        down = model.step(ids, known, goals, valid)[0]
        model.w[name][at] += 1e-5
        assert math.isclose((up - down) / 2e-5, d[name][at], rel_tol=2e-2)


def test_model_size_and_context():
    model = attention_lm.Model(np.ones(300))
    assert model.seen.sum(1).min() >= 25 and model.seen.sum(1).max() >= 48  # ids that a target sees
    assert model.w["E"].shape[1] >= 24 and model.w["H"].shape[1] >= 32


def test_windows_score_each_place_once():
    lengths = np.array([1, 24, 25, 48, 100])
    owner, first = attention_lm.windows_of(lengths)
    _, known, at, valid = attention_lm.view(np.zeros(lengths.sum(), int), np.cumsum(lengths) - lengths, lengths, owner, first)
    assert sorted(at[valid].tolist()) == list(range(lengths.sum()))


def test_quality_held_out(spark, sf):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.query(spark, sf).collect() if r["doc_id"] in truth]
    good, bad = ([r["score"] for r in rows if truth[r["doc_id"]] == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_quality_decides_on_held_out_labels(spark):
    at = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in quality.query(spark, at).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == 0 for q, p in held if q == 0) >= 0.9 * sum(q == 0 for q, _ in held) > 0
    assert sum(p == 1 for q, p in held if q == 1) >= 0.97 * sum(q == 1 for q, _ in held)


def test_quality_learns_where_every_document_is_labelled(spark):
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet").where("quality is not null")
    docs = spark.read.parquet(f"{at}/documents.parquet").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.quality(docs, labels, lambda c: crc_mod(c, 5) != 0).collect()
    good, bad = ([r["score"] for r in rows if truth[r["doc_id"]] == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.9 * len(good) * len(bad) > 0


def test_non_negative_risk_takes_only_positives():
    rng = np.random.default_rng(8)
    draw = lambda n, good: rng.normal(1.5 if good else -1.5, 1, (n, 3))
    net = quality.fit(draw(400, True), np.concatenate([draw(240, True), draw(160, False)]), 0.6, steps=300)
    assert (net.g(draw(500, True)) > 0).mean() > 0.9 and (net.g(draw(500, False)) < 0).mean() > 0.9


def plain_unlike(d):
    """Ids that the language stage rejects, by plain steps from the operator's cosines."""
    learned = {r["doc_id"] for r in d.collect() if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    rows = language_id.language_id(d, language_id.fit(d.where(crc_mod("doc_id", 4) != 2))).collect()
    usual = defaultdict(list)
    for r in rows:
        if r["doc_id"] in learned and r["n_letters"] >= 256:
            usual[r["n_letters"].bit_length()].append(r["score"])
    median = {k: sorted(v)[(len(v) - 1) // 2] for k, v in usual.items()}
    return {r["doc_id"] for r in rows if r["lang_pred"] == "und" or r["n_letters"] >= 256 and r["score"] < 0.5 * median.get(r["n_letters"].bit_length(), 0)}


def test_language_stage_drops_junk_and_keeps_clean_texts(spark):
    import corpus_pipeline

    at = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{at}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, d, at).select("doc_id").collect()}
    quality_of = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    gone = {r["doc_id"]: r["text"] for r in d.collect() if r["doc_id"] not in kept}
    assert set(gone) == plain_unlike(d) and gone and not any(quality_of.get(i) == 1 for i in gone)


def test_language_equals_plain_profiles(spark, sf, docs):
    """Cosines from dictionaries of n-gram vectors, bound letter by letter."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    prototypes = language_id.fit(d)
    letter = {}

    def of(code):
        if code not in letter:
            letter[code] = np.random.default_rng([language_id.SEED, code]).integers(0, 2, language_id.DIM, np.int8) * 2.0 - 1
        return letter[code]

    for r in sorted(language_id.language_id(d, prototypes).collect(), key=lambda r: r["doc_id"])[:25]:
        words = "".join(c if c.isalpha() else " " for c in docs[r["doc_id"]].lower()).split()
        text = " " + " ".join(words) + " "
        grams = Counter(text[i : i + 3] for i in range(len(text) - 2)) if words else Counter()
        v = sum((n**0.5 * of(ord(g[0])) * np.roll(of(ord(g[1])), 1) * np.roll(of(ord(g[2])), 2) for g, n in grams.items()), np.zeros(language_id.DIM))
        assert r["n_letters"] == sum(map(len, words))
        if words:
            cosines = {k: float(p @ v / np.linalg.norm(v)) for k, p in prototypes.items()}
            assert r["lang_pred"] == max(cosines, key=cosines.get) and math.isclose(r["score"], max(cosines.values()), rel_tol=1e-4)


def test_pipeline_against_plain_steps(spark, sf, docs):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    a = corpus_pipeline.language(spark, d, sf)
    kept = {r["doc_id"] for r in a.collect()}
    assert kept == set(docs) - plain_unlike(d)
    b = corpus_pipeline.good(spark, a, sf)
    texts = {r["doc_id"]: r["text"] for r in b.collect()}
    told = quality.quality(a, spark.read.parquet(f"{sf}/labels.parquet"), lambda c: crc_mod(c, 5) != 0).collect()
    assert set(texts) == {r["doc_id"] for r in told if r["predicted"]} and len(texts) >= 0.75 * len(docs)
    first = {}
    for i in sorted(texts):
        first.setdefault(" ".join(texts[i].split()), i)
    c = corpus_pipeline.exact(spark, b, sf)
    assert {r["doc_id"] for r in c.collect()} == set(first.values())
    left = {i: texts[i] for i in first.values()}
    want = {i for i, k in near_classes(left).items() if i == k}
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, c, sf).collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_crc_mod(spark):
    got = spark.createDataFrame([(1,), (None,)], "i long").select(crc_mod("i", 5).alias("m")).collect()
    assert [r["m"] for r in got] == [zlib.crc32(b"1") % 5, -1]


@given(st.sets(st.integers(0, 2**32), min_size=1, max_size=300), st.randoms())
def test_places_of_keys(keys, rnd):
    keys = np.array(sorted(keys), np.uint64)
    want = np.array([rnd.randrange(len(keys)) for _ in range(500)])
    assert (lm_scoring.Places(keys).of(keys[want]) == want).all()
