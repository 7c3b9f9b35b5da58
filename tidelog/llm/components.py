"""Connected components of a graph too large for one machine, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import scratch, written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the two-column table edges (a, b).

    Each round points every node at the neighbour (or itself) that comes first in a random order, then contracts: an edge
    becomes an edge between what its ends point at. A constant share of the nodes goes in every round, also on long paths;
    a star is done after one. Minima are aggregated before the shuffle, so that a node with very many neighbours sends a row
    per task. Rounds are written tables. Edges with a null end and loops count as none.
    """
    with scratch(edges.sparkSession):
        return contracted(edges)


def contracted(edges: DataFrame) -> DataFrame:
    a, b = edges.columns
    e = written(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    total = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.least(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))), F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n")))
        point = written(both.groupBy("a").agg(first["n"].alias("p")).withColumnRenamed("a", "n"))
        pa, pb = point.toDF("a", "pa"), point.toDF("b", "pb")
        e = written(e.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if total is None:
            total = point.toDF("node", "root")
        else:
            total = written(total.join(point, F.col("root") == F.col("n"), "left").select("node", F.coalesce("p", "root").alias("root")))
    if total is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    least = total.groupBy("root").agg(F.min("node").alias("component"))
    return written(total.join(least, "root").select("node", "component"), keep=True)
