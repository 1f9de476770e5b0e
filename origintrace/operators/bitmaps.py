"""Rows of a join that can't meet anything are told before they are shuffled, by a bitmap of the other side's hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_ROW, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 28  # 32 MB at most; beyond 16 million rows more pass that meet nothing
SLICE_BITS = 1 << 15  # what bitmap_construct_agg puts together


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash (the one column). Slices are put together by tasks and are all that reaches the driver."""
    place = F.pmod(F.col(hashes.columns[0]), F.lit(bits))
    placed = hashes.select(F.shiftright(place, SLICE_BITS.bit_length() - 1).cast("int").alias("slice"), (place % SLICE_BITS).alias("at")).repartition("slice")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in placed.groupBy("slice").agg(F.bitmap_construct_agg("at").alias("held")).toLocalIterator():
        out[r["slice"] * SLICE_BITS // 8 :][: SLICE_BITS // 8] = np.frombuffer(r["held"], dtype=np.uint8)
    return out


def listed(hashes: DataFrame) -> Callable[[Column], Column]:
    """A function of a column of lists of hashes: for each whether it may be one of `hashes` (the one column); never false for one
    that is."""
    rows = hashes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_ROW * rows - 1).bit_length() if rows else LEAST_BITS))
    shared = hashes.sparkSession.sparkContext.broadcast(bitmap(hashes, bits))

    @F.arrow_udf("array<boolean>")
    def there(lists: pa.Array) -> pa.Array:
        place = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)
        found = shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(found))

    return there
