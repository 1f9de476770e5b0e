"""Near duplicates of vectors by quantised tile products.

Unit vectors are rounded to 8 bits a component, and each keeps the exact length of what rounding took from it. A product of two
rounded vectors then differs from the true cosine by no more than e_x * (1 + e_y) + e_y, so most pairs are refuted, and others
proved, on the rounded ones, which are a quarter in size. Blocks of rounded vectors meet two by two, one pair of blocks a task.
Rows of pairs that stay open, and of these pairs alone, come back with their vectors for products in double precision. What
leaves a task are counts and spanning links of its rows, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

LEAST_COSINE = 0.95
BLOCK_ROWS, LEAST_BLOCK, BLOCKS = 8192, 1024, 12  # a block has that many rows at most, and is smaller while there are fewer blocks
TILE = 1024
ROUNDING = 1e-9  # over all that double precision adds to a bound
LEVELS = 127
HELD_PAIRS = 1 << 16

_OUT = "kind int, dim int, first int, second int, cid long, other long, links long"
COUNTED, LINKED, OPEN = range(3)


def finite(v: str) -> Column:
    """Not null, and no null or non-finite component."""
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def _units(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, their scale, and a bound of the length of the difference, for each unit row of x."""
    scale = np.abs(x).max(axis=1) / LEVELS
    q = np.rint(x / scale[:, None]).astype(np.int8)
    rest = x - q * scale[:, None]
    return q, scale, np.sqrt((rest * rest).sum(axis=1)) + ROUNDING


class _Side:
    """One block's rows in a task: q, scale, error, copies, cid; vectors where they came along."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        self.cid, self.copies = pdf["cid"].to_numpy(), pdf["copies"].to_numpy()
        self.scale, self.error = pdf["scale"].to_numpy(), pdf["error"].to_numpy()
        q = np.frombuffer(b"".join(pdf["q"]), dtype=np.int8).reshape(len(pdf), dim)
        self.q = q.astype(np.float32 if dim * LEVELS * LEVELS < 1 << 24 else np.float64)  # whole numbers that a float holds: the product is exact
        self.units = _units(pdf["v"]) if "v" in pdf and len(pdf) else None


class _Found:
    """Counts and spanning links of the rows of two blocks."""

    def __init__(self, x: _Side, y: _Side, same: bool):
        self.x, self.y, self.shift = x, y, 0 if same else len(x.cid)
        self.label = np.arange(self.shift + len(y.cid))
        self.links = np.zeros(len(self.label), dtype=np.int64)
        self.open = np.zeros(len(self.label), dtype=bool)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links rows i of x with rows j of y."""
        n = len(self.label)
        self.links += np.bincount(i, self.y.copies[j], n).astype(np.int64) + np.bincount(j + self.shift, self.x.copies[i], n).astype(np.int64)
        j = j + self.shift
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def left_open(self, i: np.ndarray, j: np.ndarray) -> None:
        self.open[i] = True
        self.open[j + self.shift] = True

    def rows(self, dim: int, first: int, second: int) -> pd.DataFrame:
        cid = np.concatenate([self.x.cid, self.y.cid]) if self.shift else self.y.cid
        counted, linked, open_ = np.flatnonzero(self.links), np.flatnonzero(self.label != np.arange(len(cid))), np.flatnonzero(self.open)
        at = np.concatenate([counted, linked, open_])
        kind = np.repeat([COUNTED, LINKED, OPEN], [len(counted), len(linked), len(open_)])
        return pd.DataFrame({"kind": kind, "dim": dim, "first": first, "second": second, "cid": cid[at], "other": cid[self.label[at]], "links": self.links[at]})


def _meet(x: _Side, y: _Side, same: bool, least: float, found: _Found, exact: bool) -> None:
    """Tile by tile: pairs proved by their bounds are linked; open ones are noted, or (exact) decided on the vectors."""
    for p in range(0, len(x.cid), TILE):
        for r in range(p if same else 0, len(y.cid), TILE):
            a, b = slice(p, p + TILE), slice(r, r + TILE)
            ea, eb = x.error[a], y.error[b]
            product = x.q[a] @ y.q[b].T
            loosest = least - (ea.max() * (1 + eb.max()) + eb.max()) - 1e-4  # whatever can pass, by a coarse test of the whole tile
            i, j = np.nonzero(product * y.scale[b].astype(np.float32) >= (loosest / x.scale[a]).astype(np.float32)[:, None])
            if same and p == r:
                i, j = i[i < j], j[i < j]
            about = product[i, j] * x.scale[a][i] * y.scale[b][j]
            slack = ea[i] * (1 + eb[j]) + eb[j] + ROUNDING
            i, j = i + p, j + r
            proved, open_ = about - slack >= least, (about - slack < least) & (about + slack >= least)
            if not exact:
                found.link(i[proved], j[proved])
                found.left_open(i[open_], j[open_])
                continue
            i, j = i[open_], j[open_]
            for at in range(0, len(i), HELD_PAIRS):
                u, w = i[at : at + HELD_PAIRS], j[at : at + HELD_PAIRS]
                near = np.einsum("nd,nd->n", x.units[u], y.units[w]) >= least
                found.link(u[near], w[near])


def _compared(rows: DataFrame, least: float, exact: bool) -> DataFrame:
    """Rows of _OUT for the rows (dim, first, second, block, cid, copies, scale, error, q and, if exact, v) of each pair of blocks."""

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, first, second = key
        pdf = pdf.sort_values("cid")
        y = _Side(pdf[pdf["block"] == second], dim)
        same = first == second
        x = y if same else _Side(pdf[pdf["block"] == first], dim)
        found = _Found(x, y, same)
        if len(x.cid) and len(y.cid):
            _meet(x, y, same, least, found, exact)
        return found.rows(dim, first, second)

    return rows.groupBy("dim", "first", "second").applyInPandas(compare, _OUT)


def near_vectors(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """Per row: key, n_links (other rows with a cosine of `least` or more), component_id (smallest key reachable by links).

    Equal vectors are one node with its number of copies, so copies make no pairs. Vectors of different lengths never link. A
    row without a key, or whose vector is null, empty, zero or holds a null or non-finite component, has no links and is its own
    component; rows that share a key are rows of their own; an empty table gives an empty one. Rows squared products are
    computed, less those of copies.
    """
    kind = "array<float>" if dict(rows.dtypes)[vector] == "array<float>" else "array<double>"
    given = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    usable = F.col("id").isNotNull() & finite("v") & F.exists("v", lambda x: x != 0)
    given = given.withColumn("v", F.when(usable, F.col("v")))
    classes = given.where("v is not null").groupBy("v").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "tiles-classes")  # written, so the numbers stay
    sizes = classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("m") / F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("m") / BLOCKS)))).cast("int"))

    def quantise(frames):
        for pdf in frames:
            for _, same in pdf.groupby("dim"):  # one length mostly
                q, scale, error = quantised(_units(same["v"]))
                yield same.drop(columns="v").assign(q=[x.tobytes() for x in q], scale=scale, error=error)

    placed = classes.withColumn("dim", F.size("v")).join(cut(sizes, "tiles-sizes"), "dim").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    small = cut(placed.select("cid", "copies", "dim", "blocks", "block", "v").mapInPandas(quantise, "cid long, copies long, dim int, blocks int, block int, q binary, scale double, error double"), "tiles-quantised")
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = small.withColumn("partner", partner).withColumns({"first": F.least("block", "partner"), "second": F.greatest("block", "partner")}).drop("partner", "blocks")
    refuted = cut(_compared(met, least, False), "tiles-bounds")
    open_ = refuted.where(F.col("kind") == OPEN).select("dim", "first", "second", "cid")
    again = open_.join(small.drop("dim", "blocks"), "cid").join(classes.select("cid", "v"), "cid")
    found = cut(refuted.where(F.col("kind") != OPEN).unionByName(_compared(again, least, True)), "tiles-found")

    groups = components(found.where(F.col("kind") == LINKED), "cid", "other").withColumnRenamed("node", "cid")
    links = found.where(F.col("kind") == COUNTED).groupBy("cid").agg(F.sum("links").alias("links"))
    nodes = classes.select("cid", "v", "least_id", "copies").join(links, "cid", "left").join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    nodes = cut(nodes, "tiles-nodes")
    least_of = nodes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    nodes = nodes.join(least_of, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = given.join(nodes, "v", "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op12_int8_near_vectors(spark, sf_dir):
    """Links and components of all vectors at a cosine of 0.95.

    A vector that is null, zero or holds null or non-finite components links with nothing; a null vec_id is in no link; repeated
    rows link with each other; no vectors give no rows."""
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP12_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {LEAST_COSINE}),
c(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.vec_id),
m AS (SELECT vec_id, min(root) AS component_id FROM c GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id IS NOT DISTINCT FROM component_id AS kept FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id LEFT JOIN m ON m.vec_id IS NOT DISTINCT FROM e.vec_id
"""
