"""Places of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with place (from 1) within their group by `order`, which has no ties inside a group.

    A group is no task's work: rows are dealt by ranges of group and order and ranked inside a range; a range's first group, which
    may have begun in ranges before, is counted on from there by a table of one row a range.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(rows.repartitionByRange(n, *by, *order).withColumn("range", F.spark_partition_id()), "ranked")
    counts = ranged.groupBy("range", *by).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    continued = counts.withColumn("before", before).where(F.col("before") > 0).drop("n")
    inside = F.row_number().over(Window.partitionBy("range", *by).orderBy(*order))
    out = ranged.withColumn("place", inside).join(F.broadcast(continued), ["range", *by], "left")
    return out.withColumn("place", F.col("place") + F.coalesce("before", F.lit(0))).drop("range", "before")
