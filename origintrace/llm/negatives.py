"""Hard negatives by bit-sliced integer products.

Components are whole numbers, stored as bit-planes. An anchor's product with a row is summed plane by plane, the most
significant first; what the planes to come can add lies between sums of the anchor's negative and of its positive components, so
each plane halves the interval that a score is known to lie in. A row is dropped as soon as its interval can't qualify: below
the interval of enough better rows, or outside the band that a positive's score allows. The last plane leaves exact scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table
from .tiles import finite

SCALE = 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95  # LOW and HIGH in hundredths of the positive's score
MOST_COMPONENT = 1 << 30
BLOCK_ROWS, BLOCK_ANCHORS, HELD_ANCHORS = 8192, 1024, 64
SPARSE = 0.05  # of a part's pairs: fewer are followed one anchor at a time


class Planes:
    """Rows of whole numbers as bit-planes of components moved to be at least 0."""

    def __init__(self, rows: np.ndarray, dtype):
        lowest, highest = int(rows.min(initial=0)), int(rows.max(initial=0))
        self.count = max(1, (highest - lowest).bit_length())
        self.lowest, self.moved, self.dtype = lowest, rows - lowest, dtype
        self._whole: dict[int, np.ndarray] = {}

    def plane(self, k: int, rows=None) -> np.ndarray:
        """The k-th bits, of all rows or some."""
        if rows is not None:
            return ((self.moved[rows] >> k) & 1).astype(self.dtype)
        if k not in self._whole:
            self._whole[k] = ((self.moved >> k) & 1).astype(self.dtype)
        return self._whole[k]


def exact_type(anchors: np.ndarray, rows: np.ndarray):
    """The number type that holds all sums of the products exactly."""
    bits = max(1, (int(rows.max(initial=0)) - int(rows.min(initial=0))).bit_length())
    largest = (int(np.abs(anchors).sum(axis=1).max(initial=0)) + 1) << (bits + 1)
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64


def survivors(anchors: np.ndarray, planes: Planes, asked: np.ndarray, judge):
    """For each anchor (number, rows, exact scores) of the rows that no interval rules out. asked: which rows take part, anchor by
    row. judge(anchor, lower, upper) tells which of an anchor's rows can still qualify by these intervals."""
    for at in range(0, len(anchors), HELD_ANCHORS):
        a = anchors[at : at + HELD_ANCHORS].astype(planes.dtype)
        whole = anchors[at : at + HELD_ANCHORS]
        base, falls, rises = planes.lowest * whole.sum(axis=1), np.minimum(whole, 0).sum(axis=1), np.maximum(whole, 0).sum(axis=1)
        alive = asked[at : at + HELD_ANCHORS].copy()
        known = np.zeros(alive.shape, dtype=planes.dtype)
        k = planes.count
        while k and alive.mean() > SPARSE:
            k -= 1
            known += planes.dtype(1 << k) * (a @ planes.plane(k).T)
            for i in range(len(a)):
                rows = np.flatnonzero(alive[i])
                so_far, left = known[i, rows].astype(np.int64) + base[i], (1 << k) - 1
                alive[i, rows] = judge(at + i, so_far + left * falls[i], so_far + left * rises[i])
        for i in range(len(a)):
            rows = np.flatnonzero(alive[i])
            so_far = known[i, rows].astype(np.int64) + base[i]
            for below in range(k - 1, -1, -1):
                so_far += (planes.plane(below, rows) @ a[i]).astype(np.int64) << below
                left = (1 << below) - 1
                kept = judge(at + i, so_far + left * falls[i], so_far + left * rises[i])
                rows, so_far = rows[kept], so_far[kept]
            yield at + i, rows, so_far


def _least_of_best(lower: np.ndarray, k: int) -> int | None:
    """The k-th largest of the lower bounds, if there are so many."""
    return int(np.partition(lower, len(lower) - k)[len(lower) - k]) if len(lower) >= k else None


def _can_be_best(k: int):
    def judge(_, lower, upper):
        least = _least_of_best(lower, k)
        return np.ones(len(lower), dtype=bool) if least is None else upper >= least

    return judge


def _can_be_negative(bands: list[list[tuple[int, int]]], k: int):
    """bands: for each anchor the least and largest score that each of its positives allows."""

    def judge(i, lower, upper):
        out = np.zeros(len(lower), dtype=bool)
        for low, high in bands[i]:
            sure = (lower >= low) & (upper <= high)
            least = _least_of_best(lower[sure], k)
            out |= (upper >= (low if least is None else max(low, least))) & (lower <= high)
        return out

    return judge


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _numbers(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.int64)


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _at(n: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")


def _blocks(count: str, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(count) / most)).cast("int")


def whole_rows(rows: DataFrame, key: str, label: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id, label, v: components as floor(scale * x), of rows with a key, a label and a vector without null or non-finite components.

    Of several rows with one key the least (by label, then vector) is taken. Vectors have the length that most have (of equally
    common ones the smallest); a component beyond 2^30 would make scores that no long holds, so its row takes no part.
    """
    numbers = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    good = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & finite(vector)).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), numbers.alias("v"))
    good = good.where(F.forall("v", lambda x: F.abs(x) <= MOST_COMPONENT)).withColumn("v", F.col("v").cast("array<int>"))
    good = cut(good.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*"), "negatives-rows")
    usual = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("v") == (usual[0].n if usual else 0))


def positives_of(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """anchor_id, positives (array of score, id; at most k): each anchor's first k other rows of its label. Rows and anchors of a
    label meet in blocks, so a label with a third of all rows is many tasks' work."""
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    asking = anchors.groupBy("label").agg(F.count(F.lit(1)).alias("asking"))
    labels = cut(sizes.join(asking, "label").select("label", _blocks("m", BLOCK_ROWS).alias("row_blocks"), _blocks("asking", BLOCK_ANCHORS).alias("anchor_blocks")), "negatives-labels")
    mine = rows.join(labels, "label").select("label", _at("row_blocks", 1).alias("row_block"), _every("anchor_blocks").alias("anchor_block"), "id", "v")
    asks = anchors.join(labels, "label").select("label", _every("row_blocks").alias("row_block"), _at("anchor_blocks", 2).alias("anchor_block"), "id", "v")

    def meet(rows_: pd.DataFrame, asks_: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows_) and len(asks_):
            ids, who, v, a = rows_["id"].to_numpy(), asks_["id"].to_numpy(), _numbers(rows_["v"]), _numbers(asks_["v"])
            for i, found, score in survivors(a, Planes(v, exact_type(a, v)), who[:, None] != ids[None, :], _can_be_best(k)):
                best = _first(ids[found], score, k)
                out += [(who[i], n, s) for n, s in zip(ids[found][best], score[best], strict=True)]
        return pd.DataFrame(out, columns=["anchor_id", "id", "score"]).astype("int64")

    by = ["label", "row_block", "anchor_block"]
    found = mine.groupBy(*by).cogroup(asks.groupBy(*by)).applyInPandas(meet, "anchor_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    best = found.withColumn("place", place).where(F.col("place") <= k)
    return best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))


def hard_negatives(rows: DataFrame, is_anchor: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (id, label, v: whole numbers, ids once).

    For each anchor and each of its first positives, the first rows of other labels whose score is between low and high
    hundredths of the positive's. An anchor without another row of its label has no positives; one without rows in the band has
    none for that positive; an empty table gives no rows.
    """
    anchors = rows.where(is_anchor).select(*[F.col(c).alias(c) for c in ("id", "label", "v")])  # columns of their own, for joins and cogroups with rows
    asked = cut(anchors.join(positives_of(rows, anchors, positives).withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "v", "positives"), "negatives-anchors")
    row_blocks, anchor_blocks = (max(1, -(-df.count() // most)) for df, most in ((rows, BLOCK_ROWS), (asked, BLOCK_ANCHORS)))
    both = {"row_blocks": F.lit(row_blocks), "anchor_blocks": F.lit(anchor_blocks)}
    mine = rows.withColumns(both).select(_at("row_blocks", 1).alias("row_block"), _every("anchor_blocks").alias("anchor_block"), "id", "label", "v")
    asks = asked.withColumns(both).select(_every("row_blocks").alias("row_block"), _at("anchor_blocks", 2).alias("anchor_block"), "id", "label", "v", "positives")

    def meet(rows_: pd.DataFrame, asks_: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows_) and len(asks_):
            ids, who, v, a = rows_["id"].to_numpy(), asks_["id"].to_numpy(), _numbers(rows_["v"]), _numbers(asks_["v"])
            wanted = [[(p["id"], p["score"]) for p in ps] for ps in asks_["positives"]]
            bands = [[(-(-low * s // 100), high * s // 100) for _, s in ps] for ps in wanted]
            other = asks_["label"].to_numpy()[:, None] != rows_["label"].to_numpy()[None, :]
            for i, found, score in survivors(a, Planes(v, exact_type(a, v)), other, _can_be_negative(bands, negatives)):
                for (p, s), (least, most) in zip(wanted[i], bands[i], strict=True):
                    inside = np.flatnonzero((score >= least) & (score <= most))
                    best = inside[_first(ids[found][inside], score[inside], negatives)]
                    out += [(who[i], p, n, s, t) for n, t in zip(ids[found][best], score[best], strict=True)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]).astype("int64")

    by = ["row_block", "anchor_block"]
    found = mine.groupBy(*by).cogroup(asks.groupBy(*by)).applyInPandas(meet, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_bit_sliced_negatives(spark, sf_dir):
    """Three hard negatives for each of the five positives of each vector whose id is divisible by 50, among all vectors.

    Rows with a null id, label or vector, or a null or non-finite component, take no part (zero vectors do); rows of one id count
    as one; ties go to smaller ids; no vectors give no rows."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_rows(vectors.select("vec_id", label.alias("label"), "embedding"), "vec_id", "label", "embedding")
    return hard_negatives(rows, F.col("id") % 50 == 0)


OP13_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}
"""
