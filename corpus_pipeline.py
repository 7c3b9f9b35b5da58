"""The corpus pipeline: language ID, quality, exact dedup, near dedup, packing.

Every stage works on the whole output of the one before, which was written as Parquet and reread. The filtering stages return
the columns of documents, whatever these are, and drop whole rows only:

- language: texts without a letter go, and long ones whose cosine is far under that of learned texts of their length (`unlike`);
- quality: texts with a score under 0.3 go;
- exact: of equal texts the smallest doc_id stays; near: of each component of near copies the smallest doc_id stays.

Rows with a null doc_id can't be told apart by id and pass all filters. Rows that repeat an id pass or go together. An empty table
passes every stage as an empty one; very long texts are worked on whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import crc_mod, kept_rows, remove, scratch, work_dir, written
from tidelog.llm.exact_dedup import without_copies
from tidelog.llm.language_id import fit, language_id, unlike
from tidelog.llm.minhash_dedup import without_near_copies
from tidelog.llm.packing import pack
from tidelog.llm.quality import quality


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, learning from the rows that may be learned from."""
    learn = crc_mod("doc_id", 4) != 2
    with scratch(spark):
        found = written(language_id(docs, fit(docs.where(learn)), more=(("learned", learn & F.col("lang").isNotNull(), "boolean"),)))
        rejected = written(unlike(found), keep=True)
    return kept_rows(docs, "doc_id", rejected, "left_anti")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, with the labels beside the documents."""
    scores = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda c: crc_mod(c, 5) != 0)
    rejected = written(scores.where("predicted = 0 and doc_id is not null").select("doc_id").distinct())
    return kept_rows(docs, "doc_id", rejected, "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6."""
    return without_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", good), ("exact", exact), ("near", near), ("packing", packed)]

#: SQL can't express the learned stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and reread."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{work_dir(spark)}/{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)  # only the last stage's table is still read
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
