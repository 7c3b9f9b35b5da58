"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only.

Texts are equal when identical after every run of blanks (space, tab to carriage return) becomes one space; a null text
is an empty one. Each level keeps only the groups of the level before that have two rows or more:

1. ``n``: bytes of the normalised text;
2. ``p``: a 64-bit hash of its first ``prefix`` characters;
3. ``h``: sha256 of all of it, needed only for rows that are left.

Levels group by partial aggregation, so that one text held by a third of the rows sends a row per task. The groups of a level are a
written table; the rows then meet them in an equi-join whose two sides are shuffled for it alone, so that adaptive execution may
split its hot keys or broadcast groups that turn out small. Texts themselves are never shuffled on level 1 and 2.

With ``digests="all"`` the caller wants the sha256 of every row besides; it is then computed in the first scan, which saves
the second one. With ``digests="survivors"`` the second scan reads the text of the rows that are left and of no others.

Defined cases: rows with a null id are never the one that stays, unless all ids of the group are null (then ``keep_id`` is
null and they stay); rows that repeat both id and text (an id has one text) all count in ``group_size`` and share ``kept``; an empty table gives
an empty result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import kept_rows, written


def normalised(text: str | Column) -> Column:
    """Every run of blanks as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, digests: str = "survivors") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (null for rows told apart earlier, unless digests="all")."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("t"))
    sha = F.unhex(F.sha2("t", 256))
    first = {"n": F.octet_length("t"), "p": F.xxhash64(F.substring("t", 1, prefix))} | ({"h": sha} if digests == "all" else {})
    marks = written(rows.select("doc_id", *(c.alias(k) for k, c in first.items())))
    lengths = written(marks.groupBy("n").agg(F.count("*").alias("c")).where("c > 1").select("n"))
    left = marks.join(lengths, "n", "left_semi")
    prefixes = written(left.groupBy("n", "p").agg(F.count("*").alias("c")).where("c > 1").select("n", "p"))
    left = marks.join(prefixes, ["n", "p"], "left_semi")
    if digests != "all":
        ids = written(left.select("doc_id").distinct())
        left = kept_rows(rows, "doc_id", ids.where("doc_id is not null"), "left_semi").unionByName(rows.where("doc_id is null"))
        left = written(left.select("doc_id", *(c.alias(k) for k, c in (first | {"h": sha}).items())))
    groups = written(left.groupBy("n", "p", "h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    if digests == "all":
        out = marks.join(groups, ["n", "p", "h"], "left")
    else:
        found = written(left.join(groups, ["n", "p", "h"]).select(F.col("doc_id").alias("i"), F.col("n").alias("fn"), F.col("p").alias("fp"), "h", "keep_id", "group_size").dropDuplicates(["i", "fn", "fp", "h"]))
        out = marks.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("n") == F.col("fn")) & (F.col("p") == F.col("fp")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("h")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, all columns as they were."""
    dropped = written(exact_dedup(docs, id_col, text_col).where("not kept and doc_id is not null").select("doc_id").distinct())
    return kept_rows(docs, id_col, dropped, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests="all")


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
