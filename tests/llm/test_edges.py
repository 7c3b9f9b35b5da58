"""Each operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import byte_bpe, embedding_dedup, exact_dedup, language_id, license_scan, lm_scoring, minhash_dedup, packing, quality, token_files
from tidelog.llm.common import crc_mod, work_dir

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = "the quick brown fox jumps over the lazy dog and runs away " * 3000
ROWS = [(1, None, "en"), (2, "", None), (3, "one two three four five six", "en"), (3, "one two three four five six", "en"), (4, "one  two three four five six", "en"), (5, LONG, "en"), (None, "null id text here", None), (6, "!!! ???", None), (7, "\U0001f600 ünï 文字", "xx")]
#: Names that the operators use inside.
CLASH = ["n", "p", "h", "t", "key", "sig", "rep", "bucket", "chunk", "row", "k", "id", "score", "ids", "length", "__kept_rows_id", "f", "class_id", "kept"]


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select(F.lit("s").alias("source"), F.lit(7).cast("long").alias("n_chars"), "*", *(F.lit("clash").alias(c) for c in CLASH))


def in_order(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key] or 0))


OPS = {
    "license": lambda s, d: license_scan.license_scan(d),
    "bpe": lambda s, d: byte_bpe.byte_bpe(d, RANKS, public_tokenizers.PATTERN),
    "language": lambda s, d: language_id.language_id(d, language_id.fit(d)),
    "exact": lambda s, d: exact_dedup.exact_dedup(d),
    "exact_all": lambda s, d: exact_dedup.exact_dedup(d, digests="all"),
    "near": lambda s, d: minhash_dedup.near_dedup(d),
    "packing": lambda s, d: packing.pack(d, WORDS).where("start = 0"),
    "lm": lambda s, d: lm_scoring.lm_scores(d, WORDS, crc_mod("doc_id", 5) == 1),
    "quality": lambda s, d: quality.quality(d, s.createDataFrame([(3, 1), (3, 0), (5, None), (99, 1), (None, 1)], "doc_id long, quality int"), lambda c: crc_mod(c, 5) != 0),
}


@pytest.mark.parametrize("name", OPS)
def test_rows_in_are_rows_out(spark, name):
    got = in_order(OPS[name](spark, table(spark)))
    assert [r["doc_id"] for r in got] == [1, 2, 3, 3, 4, 5, 6, 7, None]


@pytest.mark.parametrize("name", OPS)
def test_an_empty_table_gives_an_empty_result(spark, name):
    assert OPS[name](spark, table(spark, [])).count() == 0


def test_license_values(spark):
    got = license_scan.license_scan(spark.createDataFrame([(1, "MIT License. the mit license"), (2, None), (3, "licensed under CC BY-NC 4.0")], "doc_id long, text string"))
    a, b, c = in_order(got)
    assert (a["n_words"], a["n_base"], a["first_word"], a["last_word"], a["base_labels"], a["labels"], a["score"]) == (5, 2, 0, 3, "mit", "mit", 1.0)
    assert tuple(b)[1:] == (0, 0, None, None, "", "", 0.0) and (c["n_base"], c["labels"], c["first_word"]) == (0, "cc-by-nc", None)


def test_exact_values(spark):
    for digests in ("all", "survivors"):
        got = {(r["doc_id"], r["group_size"], r["kept"], r["keep_id"]) for r in exact_dedup.exact_dedup(table(spark), digests=digests).collect()}
        assert got == {(1, 2, True, 1), (2, 2, False, 1), (3, 3, True, 3), (4, 3, False, 3), (5, 1, True, 5), (6, 1, True, 6), (7, 1, True, 7), (None, 1, True, None)}
    out = exact_dedup.without_copies(table(spark))
    assert out.columns == table(spark).columns and [r["doc_id"] for r in in_order(out)] == [1, 3, 3, 5, 6, 7, None]


def test_near_values(spark):
    got = in_order(minhash_dedup.near_dedup(table(spark)))
    assert [(r["class_id"], r["class_size"], r["kept"]) for r in got] == [(1, 1, True), (2, 1, True), (3, 3, True), (3, 3, True), (3, 3, False), (5, 1, True), (6, 1, True), (7, 1, True), (None, 1, True)]


def test_language_values(spark):
    got = {r["doc_id"]: r for r in OPS["language"](spark, table(spark)).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[6]["lang_pred"] == "und" and got[1]["score"] == 0 and got[5]["lang_pred"] == "en" and got[7]["lang_pred"] == "xx"
    assert {r["lang_pred"] for r in language_id.language_id(table(spark), {}).collect()} == {"und"}


def test_token_files_values(spark):
    d, folder = table(spark), work_dir(spark)
    files = token_files.write_files(d, WORDS, folder, file_ids=1000)
    got = token_files.read_files(spark, folder, files).collect()
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 4, 5, 6, 7] and files.count() >= 2
    assert [r["start"] for r in got[1:]] == [r["start"] + r["n_tokens"] for r in got[:-1]] and list(got[1]["ids"]) == [1]
    empty = work_dir(spark)
    assert token_files.write_files(table(spark, []), WORDS, empty).count() == 0


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("v", "ok", "rep", "t", "sub")})
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(df).collect()}
    alone = {(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)} | {(None, 0, None, True)}
    assert got == alone | {(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)}
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [1.0, 0.01], "a"), (3, [0.01, 1.0], "a")], "vec_id long, embedding array<double>, label string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(twice).collect())
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (3, 1, 2)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, tmp_path, name):
    spark.createDataFrame([(3, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage, d = dict(corpus_pipeline.STAGES)[name], table(spark)
    out = stage(spark, d, str(tmp_path))
    if name != "packing":
        assert out.columns == d.columns
    want = {"language": [3, 3, 4, 5, 7, None], "exact": [1, 3, 3, 5, 6, 7, None], "near": [1, 2, 3, 3, 5, 6, 7, None]}.get(name)
    assert want is None or [r["doc_id"] for r in in_order(out)] == want
    assert stage(spark, table(spark, []), str(tmp_path)).count() == 0


def test_near_ids_that_repeat_with_other_texts(spark):
    a, b = ("one two three four five six seven eight nine ten " * 3, " ".join(f"w{i}" for i in range(30)))
    rows = [(1, a), (2, b), (3, a + " eleven"), (3, b), (4, "alone " * 9)]
    for order in (rows, rows[::-1]):
        got = {(r["doc_id"], r["class_id"], r["class_size"]) for r in minhash_dedup.near_dedup(spark.createDataFrame(order, "doc_id long, text string")).collect()}
        assert got == {(1, 1, 2), (3, 1, 2), (2, 2, 2), (3, 2, 2), (4, 4, 1)}


def test_scratch_tables_go_and_kept_ones_stay(spark):
    from tidelog.llm.common import scratch, written

    with scratch(spark):
        with scratch(spark):
            gone, inner = written(spark.range(3)), written(spark.range(4), keep=True)
        assert inner.count() == 4
        kept = written(inner, keep=True)
    assert kept.count() == 4
    for t in (gone, inner):
        with pytest.raises(Exception, match="exist"):
            t.count()


def test_samples_at_any_size(spark):
    from tidelog.llm.common import below, sampled

    df = spark.range(20000).withColumn("text", F.lit("same"))
    assert 800 < df.where(below(0.05, "id", "text")).count() < 1200 and df.where(below(1.0, "id")).count() == 20000
    wanted = int(20_000 / 5e10 * 2.0**63)  # hashes that a share of 20,000 of 5e10 rows lets through
    assert wanted > 3e12 and df.where(below(20_000 / 5e10, "id")).count() == 0
    assert 400 < sampled(df, 20000, 500, "id", "text").count() < 600
    assert sampled(df, 20000, 500, "text").count() == 1 and sampled(df.limit(0), 0, 5, "id").count() == 0


def test_lm_words_of_very_many_ids(spark):
    long = "x1" * 40_000
    rows = [(2, f"before {long} after the word"), (3, "before"), (4, "after the word"), (5, long)]
    got = in_order(lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, F.lit(False), every=10**12, max_train=0))
    alone = in_order(lm_scoring.lm_scores(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(4, "doc_id"), WORDS, F.lit(False), every=10**12, max_train=0))
    assert [r["n_tokens"] for r in got] == [6, 2, 4, 2] and all(r["n_known"] == r["n_tokens"] for r in got)
    assert all(abs(a["score"] - b["score"]) < 1e-3 * abs(a["score"]) for a, b in zip(got, alone))
