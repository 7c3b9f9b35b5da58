"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.tables import cut


def discrete(df: DataFrame, key: str, value: str, mills: dict[str, int]) -> DataFrame:
    """key, n (rows), and a column for each of mills: the value of rank ceil(m/1000 of the non-null values), 1 at least.

    No group meets in one task: the distinct values with their counts are dealt by range, a running total goes over the sums of
    the parts, and only the parts that hold a wanted rank are numbered. A null key is a group; of nulls alone, the quantiles are null.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: parts stay ranges
    counts = df.select(F.struct(key).alias("k"), F.col(value).alias("v")).groupBy("k", "v").agg(F.count("*").alias("n"), F.count("v").alias("c"))
    dealt = cut(counts.repartitionByRange(parts, "k", "v").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("k", "part").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    whole = Window.partitionBy("k")
    before = F.sum("c").over(whole.orderBy("part")) - F.col("c")
    ranks = F.array(*(F.struct(F.lit(q).alias("q"), F.expr(f"greatest((total * {m} + 999) div 1000, 1)").alias("rank")) for q, m in mills.items()))
    wanted = sums.select("k", "part", "c", before.alias("before"), F.sum("c").over(whole).alias("total")).select("k", "part", "c", "before", F.explode(ranks).alias("x"))
    wanted = wanted.where("x.rank > before AND x.rank <= before + c").groupBy("k", "part", "before").agg(F.collect_list("x").alias("xs"))  # a part or two for each quantile
    inner = F.sum("c").over(Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    found = dealt.select("k", "part", "v", "c").join(wanted, ["k", "part"]).withColumn("upto", inner).select("k", "v", "c", "upto", F.explode("xs").alias("x"))
    found = found.where("x.rank > upto - c AND x.rank <= upto").groupBy("k").agg(*(F.max(F.when(F.col("x.q") == q, F.col("v"))).alias(q) for q in mills))
    return sums.groupBy("k").agg(F.sum("n").alias("n")).join(found, "k", "left").select(F.col("k")[key].alias(key), "n", *mills)
