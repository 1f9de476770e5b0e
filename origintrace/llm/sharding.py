"""Hilbert-curve sharding: quantised metadata dimensions, rows ordered by curve index, and runs cut off as shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, scratch, table


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of coords (n rows of d integers below 2**bits), by the transpose form of the index:
    undo the excess rotations from the top bit down, Gray-encode, and interleave the bits."""
    x = coords.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(high, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def quantise_number(value: Column, low: float, high: float, bits: int) -> Column:
    """Linear in [low, high]; beyond it, the ends; null: 0."""
    top = (1 << bits) - 1
    if not high > low:
        return F.lit(0)
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(top), F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(top)))), F.lit(0)).cast("int")


def quantise_log(value: Column, bits: int) -> Column:
    """Eighths of powers of two; null: 0."""
    return F.coalesce(F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.greatest(value, F.lit(0)) + 1) * 8)), F.lit(0)).cast("int")


def quantise_name(value: Column, bits: int) -> Column:
    """Names have no order of use here: a hash, equal names alike; null: 0."""
    return F.coalesce(F.pmod(F.xxhash64(value), F.lit(1 << bits)), F.lit(0)).cast("int")


def hilbert_shards(rows: DataFrame, dims: dict[str, Column], n_shards: int, *, size: str, tie: list[str], law: str = "rows", bits: int = 8) -> DataFrame:
    """rows with hilbert, shard and slot (the place in the shard, gapless from 0).

    law rows: shards' row counts differ by one at most. law bytes: a row is in the shard that its first byte, counted along
    the curve, falls in, so sizes differ by less than two rows. Order: curve index, then the columns in tie. Columns
    hilbert, shard and slot of the input are replaced; an empty table gives an empty table; repeated rows get places of
    their own.

    Rows are range-partitioned by (index, tie), so a cell with a third of all rows is still spread as long as tie tells
    rows apart. The driver sees one count a partition, no rows.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    rows = rows.drop("hilbert", "shard", "slot", *[c for c in rows.columns if c.startswith("hs_")])

    @F.pandas_udf("long")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), bits))

    spark = rows.sparkSession
    indexed = rows.withColumn("hilbert", curve(F.struct(*[c.cast("int").alias(f"d{i}") for i, c in enumerate(dims.values())])))
    indexed = cut(indexed.repartitionByRange(max(parts(spark), 8), "hilbert", *tie).sortWithinPartitions("hilbert", *tie).withColumn("hs_row", F.monotonically_increasing_id()), "hilbert-order")
    part, weight = F.shiftright("hs_row", 33), F.lit(1) if law == "rows" else F.coalesce(F.col(size), F.lit(0))
    sums = {r.part: (r.n, r.w) for r in indexed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).collect()}
    total = sum(w for _, w in sums.values())
    offsets, at = [], 0
    for p in sorted(sums):
        offsets.append((p, at))
        at += sums[p][1]
    indexed = indexed.withColumn("hs_part", part).join(spark.createDataFrame(offsets, "hs_part long, hs_offset long"), "hs_part")
    if law == "rows":
        start = F.col("hs_offset") + F.col("hs_row").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        start = F.col("hs_offset") + F.sum(weight).over(Window.partitionBy("hs_part").orderBy("hs_row").rowsBetween(Window.unboundedPreceding, 0)) - weight
    placed = indexed.withColumn("shard", F.least(F.floor(start * F.lit(n_shards) / F.lit(max(total, 1))), F.lit(n_shards - 1)).cast("int"))
    if law == "rows":
        first = F.ceil(F.col("shard").cast("long") * F.lit(total) / F.lit(n_shards))
        return placed.withColumn("slot", (start - first).cast("long")).drop("hs_part", "hs_offset", "hs_row")
    heads = placed.groupBy("shard", "hs_part").agg(F.min("hs_row").alias("hs_first"), F.count(F.lit(1)).alias("hs_n"))
    earlier = Window.partitionBy("shard").orderBy("hs_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("hs_before", F.coalesce(F.sum("hs_n").over(earlier), F.lit(0))).drop("hs_n")
    return placed.join(heads, ["shard", "hs_part"]).withColumn("slot", F.col("hs_row") - F.col("hs_first") + F.col("hs_before")).drop("hs_part", "hs_offset", "hs_row", "hs_first", "hs_before")


def write_shards(sharded: DataFrame, path: str | None = None) -> str:
    """One folder a shard, rows in curve order, so that min/max statistics of several dimensions prune files."""
    path = path or scratch(sharded.sparkSession, "shards")
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def op3_hilbert_shards(spark, sf_dir):
    """All documents in 40 shards along the curve of source, language, size and doc_id; law rows."""
    docs = table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    dims = {"source": quantise_name(F.col("source"), 8), "lang": quantise_name(F.col("lang"), 8), "size": quantise_log(F.col("size"), 8), "id": quantise_number(F.col("doc_id"), low or 0, high or 0, 8)}
    return hilbert_shards(rows, dims, 40, size="size", tie=["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
