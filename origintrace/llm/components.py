"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few_tasks


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or one that has a smaller one itself."""
    two = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    onward = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
    return bool(two.unionByName(onward).take(1))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable), for every node that a link names; null ends and loops are ignored.

    Each step writes its edges to the shared folder, until every node has its component's smallest
    as its one neighbour. A hub's neighbours are never gathered: a step is a grouped minimum and a join.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "star-edges")
    rows = edges.count()
    kept = lambda df, name: cut(few_tasks(df, rows), name)  # noqa: E731  steps never have more edges
    least_of = lambda df: kept(df.groupBy("u").agg(F.min("v").alias("m")), "star-least")  # noqa: E731  written, so that a join with it shuffles both sides and AQE can split a hub

    while _unfinished(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = kept(both.join(least_of(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "star-large")
        least = least_of(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = kept(small.distinct(), "star-edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
