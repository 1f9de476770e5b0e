"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample and every row is put into a leaf. A query goes down the tree through a priority queue
of nodes, best bound of the inner product first (the centroid's product, and how far the node's rows spread), and visits leaves
until it has as many as calibration found to reach a wanted recall: a few queries are answered exactly over all rows, and the
visits are widened until their neighbours' leaves are covered. Neighbouring leaves lie on a shelf; queries and rows meet by
shelf, where a query comes once with the list of its leaves, in blocks of bounded size, so a leaf with a third of all rows is
many tasks' work.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, cut, parts, table

LEAF_POWER = 0.5  # the table's row count to this power is the number of leaves
MOST_LEAVES = 65536  # of a tree: the bound of what is broadcast
SAMPLE_ROWS, ROWS_A_LEAF = 16384, 8  # the tree is fitted on so many rows, by a hash of them, or so many a leaf where that is more
BRANCHING = 8
CALIBRATION_QUERIES = 96
WANTED_RECALL = 0.95
WIDTHS = (0.0, 0.5, 1.0, 2.0, 3.0)  # how much of a node's spread its bound takes; calibration takes what needs the fewest visits
SHELVES = 8  # of a table, as long as none has more rows than a task may: a query brings k rows from each that it visits
SHELF_ROWS, BLOCK_QUERIES = 65536, 4096  # of one task at most
HELD_PRODUCTS = 1 << 21


class Tree:
    """Centroids of nodes, how far their rows spread from them in one direction, child lists, and a leaf number (or -1) for each
    node; node 0 is the root. Leaves are numbered in the order of the tree, so neighbours in number are neighbours."""

    def __init__(self, sample: np.ndarray, leaves: int, branching: int = BRANCHING, seed: int = 5):
        rng = np.random.default_rng(seed)
        spread = lambda x, c: float(np.sqrt(((x - c) ** 2).mean())) if len(x) else 0.0
        self.centroids, self.children = [sample.mean(axis=0)], [[]]
        self.spread = [spread(sample, self.centroids[0])]
        sizes = [(-len(sample), 0, np.arange(len(sample)))]
        n_leaves = 1
        while sizes and n_leaves < leaves:  # the largest leaf is split next
            size, node, rows = heapq.heappop(sizes)
            k = min(branching, leaves - n_leaves + 1, -size)
            parts = self._split(sample[rows], k, rng) if k > 1 else None
            if parts is None:
                continue
            for centroid, members in parts:
                self.children[node].append(len(self.children))
                heapq.heappush(sizes, (-len(members), len(self.children), rows[members]))
                self.centroids.append(centroid)
                self.spread.append(spread(sample[rows[members]], centroid))
                self.children.append([])
            n_leaves += len(parts) - 1
        self.centroids, self.spread = np.array(self.centroids), np.array(self.spread)
        self.leaf, self.n_leaves, below = [-1] * len(self.children), 0, [0]
        while below:
            node = below.pop()
            below += reversed(self.children[node])
            if not self.children[node]:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1

    @staticmethod
    def _split(x: np.ndarray, k: int, rng) -> list | None:
        """Lloyd's algorithm; None if all rows are equal."""
        distinct = np.unique(x[rng.permutation(len(x))[: 64 * k]], axis=0)
        if len(distinct) < 2:
            distinct = np.unique(x, axis=0)
            if len(distinct) < 2:
                return None
        centres = distinct[rng.permutation(len(distinct))[:k]]
        for _ in range(10):
            near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
            used = np.unique(near)
            centres = np.array([x[near == c].mean(axis=0) for c in used])
            near = np.searchsorted(used, near)
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        found = [(centres[c], np.flatnonzero(near == c)) for c in np.unique(near)]
        return found if len(found) > 1 else None

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at each node, the child with the nearest centroid."""
        at = np.zeros(len(x), dtype=np.int64)
        open_rows = np.arange(len(x)) if self.children[0] else np.arange(0)
        while len(open_rows):
            for node in np.unique(at[open_rows]):
                rows = open_rows[at[open_rows] == node]
                below = np.array(self.children[node])
                c = self.centroids[below]
                at[rows] = below[np.argmin((c**2).sum(1) - 2 * x[rows] @ c.T, axis=1)]
            open_rows = open_rows[[bool(self.children[n]) for n in at[open_rows]]]
        return np.array(self.leaf)[at]

    def best_first(self, query: np.ndarray, width: float):
        """Leaves by a best-bin-first walk; width is how much of a node's spread is added to its centroid's product."""
        products = self.centroids @ query + width * np.linalg.norm(query) * self.spread
        queue = [(-products[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
            for child in self.children[node]:
                heapq.heappush(queue, (-products[child], child))


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (floats or doubles, as they are): vectors that are not null, empty or zero, hold no null and no non-finite component, and have the
    length that most have (of equally common lengths, the smallest)."""
    v = F.col(vector) if dict(rows.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(finite).where(F.exists("v", lambda x: x != 0))
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("v") == (lengths[0].n if lengths else 0))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Products summed in one order, so that equal vectors have equal scores wherever they are."""
    return (rows * q).sum(axis=1)


def _best(q_ids, q, ids, rows, k, seen=None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query its k best rows (not of its own id), ties to smaller ids. seen: for each slice of the rows the queries that see it."""
    out = []
    step = max(1, HELD_PRODUCTS // max(1, len(rows)))
    longest = np.linalg.norm(rows, axis=1).max(initial=0.0)
    for at in range(0, len(q), step):
        some = slice(at, at + step)
        if seen is None:
            fast = q[some] @ rows.T
        else:
            fast = np.full((len(q[some]), len(rows)), -np.inf)
            for span, who in seen:
                mine = np.flatnonzero(who[some])
                if len(mine):
                    fast[mine, span] = q[some][mine] @ rows[span].T
        fast[q_ids[some][:, None] == ids[None, :]] = -np.inf
        slack = 1e-9 * np.linalg.norm(q[some], axis=1) * longest
        for i, products in enumerate(fast):
            least = np.partition(products, len(ids) - k)[len(ids) - k] - slack[i] if len(ids) > k else -np.inf
            near = np.flatnonzero((products >= least) & (products > -np.inf))
            score = _exact(q[at + i], rows[near])
            order = np.lexsort((ids[near], -score))[:k]
            out.append((np.full(len(order), q_ids[at + i]), ids[near][order], score[order]))
    return out


def _frame(found) -> pd.DataFrame:
    q, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
    return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})


def brute_force(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of a stated, small set of queries (collected here) over all rows, in blocks."""
    held = queries.toPandas()
    if not len(held):
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    q_ids, q = held["id"].to_numpy(), _matrix(held["v"])

    def scan(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                yield _frame(_best(q_ids, q, part["id"].to_numpy(), _matrix(part["v"]), k))

    return _ranked(rows.select("id", "v").mapInPandas(scan, "query_id long, vec_id long, score double"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class Index:
    """Tree, rows with their leaves (a table in the shared folder), rows a leaf, the calibrated number of leaf visits, and the share
    of all rows that a query compares itself with by that."""

    def __init__(self, rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = WANTED_RECALL, sample_rows: int = SAMPLE_ROWS, leaf_power: float = LEAF_POWER):
        good = usable(rows, key, vector)
        n = good.count()
        leaves = min(MOST_LEAVES, round(n**leaf_power))
        held = bounded_sample(good, F.xxhash64("id", "v"), max(sample_rows, ROWS_A_LEAF * leaves)).toPandas()
        self.k, self.spark, self.visits, self.width, self.share = k, rows.sparkSession, 0, 0.0, 0.0
        if not n:
            self.rows, self.tree, self.sizes = good.withColumn("leaf", F.lit(0)), None, np.zeros(1, dtype=int)
            return
        tree = self.tree = Tree(_matrix(held["v"]), min(leaves, max(1, len(held) // 4)))

        def place(frames):
            for pdf in frames:
                if len(pdf):
                    yield pdf.assign(leaf=tree.place(_matrix(pdf["v"])).astype(np.int32))

        self.rows = cut(good.mapInPandas(place, f"id long, v {dict(good.dtypes)['v']}, leaf int"), "ann-leaves")
        counts = dict(self.rows.groupBy("leaf").count().collect())
        self.sizes = np.array([counts.get(leaf, 0) for leaf in range(tree.n_leaves)])
        self._calibrate(recall)

    def _calibrate(self, recall: float) -> None:
        """Widens the visits until they cover that part of the exact neighbours of the calibration queries, for each width; the
        width whose visits compare with the fewest rows is taken."""
        asked = self.rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION_QUERIES).select("id", "v").dropDuplicates(["id"])
        truth = brute_force(asked, self.rows, self.k).join(self.rows.select(F.col("id").alias("vec_id"), "leaf").dropDuplicates(["vec_id"]), "vec_id").select("query_id", "leaf").collect()
        vectors = {r.id: np.array(r.v) for r in asked.collect()}
        best = None
        for width in WIDTHS:
            walks = {q: np.fromiter(self.tree.best_first(v, width), dtype=np.int64) for q, v in vectors.items()}
            rank = {q: np.argsort(walk) for q, walk in walks.items()}
            needed = np.sort([rank[r.query_id][r.leaf] + 1 for r in truth]) if truth else np.ones(1)
            visits = 1
            while visits < self.tree.n_leaves and np.searchsorted(needed, visits, side="right") / len(needed) < recall:
                visits = min(self.tree.n_leaves, max(visits + 1, int(visits * 1.1)))
            share = float(np.mean([self.sizes[walk[:visits]].sum() for walk in walks.values()]) / self.sizes.sum())
            if best is None or share < best[0]:
                best = share, visits, width
        self.share, self.visits, self.width = best

    def _shelves(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The shelf of each leaf, by filling shelves with neighbours up to so many rows, and each shelf's rows."""
        shelf, held, rows = np.zeros(len(self.sizes), dtype=np.int64), 0, []
        for leaf, size in enumerate(self.sizes):
            if leaf and held + size > most:
                rows.append(held)
                held = 0
            shelf[leaf] = len(rows)
            held += int(size)
        return shelf, np.array([*rows, held])

    def search(self, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, rank, vec_id, score: the k largest inner products found, in double precision, nearest first.

        Repeated query ids ask once (their smallest vector); repeated rows are rows of their own. A query visits more leaves than
        calibrated where those hold fewer than 4k rows. Unusable queries have no rows.
        """
        spark, tree, k = self.spark, self.tree, self.k
        schema = "query_id long, vec_id long, score double"
        if tree is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        asked = usable(queries, key, vector).groupBy("id").agg(F.min("v").alias("v"))
        sizes, visits, width, n = self.sizes, self.visits, self.width, parts(spark)
        shelf, held = self._shelves(min(SHELF_ROWS, max(256, -(-int(sizes.sum()) // SHELVES))))

        def walk(frames):
            for pdf in frames:
                found = []
                for i, v in enumerate(_matrix(pdf["v"]) if len(pdf) else ()):
                    rows, leaves = 0, []
                    for n, leaf in enumerate(tree.best_first(v, width)):
                        if n >= visits and rows >= 4 * k:
                            break
                        rows += sizes[leaf]
                        leaves.append(leaf)
                    leaves = np.sort(np.array(leaves, dtype=np.int32))
                    for part in np.split(leaves, np.flatnonzero(np.diff(shelf[leaves])) + 1):
                        found.append((i, shelf[part[0]], part))
                    if len(found) >= 5000 or i == len(pdf) - 1:
                        at = [f[0] for f in found]
                        yield pd.DataFrame({"query_id": pdf["id"].to_numpy()[at], "q": pdf["v"].to_numpy()[at], "shelf": [int(f[1]) for f in found], "leaves": [f[2] for f in found]})
                        found = []

        walked = asked.repartition(n).mapInPandas(walk, f"query_id long, q {dict(asked.dtypes)['v']}, shelf int, leaves array<int>")
        visited = cut(walked, "ann-visits")
        asking = dict(visited.groupBy("shelf").count().collect())
        blocks = [(leaf, int(s), int(-(-held[s] // SHELF_ROWS)) or 1, -(-asking.get(int(s), 0) // BLOCK_QUERIES) or 1) for leaf, s in enumerate(shelf)]
        cuts = spark.createDataFrame(blocks, "leaf int, shelf int, row_blocks int, query_blocks int")  # at most MOST_LEAVES rows
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = self.rows.join(F.broadcast(cuts), "leaf").select("shelf", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("row_blocks")).cast("int").alias("row_block"), every("query_blocks").alias("query_block"), "leaf", "id", "v")
        asks = visited.join(F.broadcast(cuts.drop("leaf").distinct()), "shelf").select("shelf", every("row_blocks").alias("row_block"), F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("query_block"), "query_id", "q", "leaves")

        def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(theirs):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
            mine = mine.sort_values("leaf", kind="stable")
            leaf = mine["leaf"].to_numpy()
            here, starts = np.unique(leaf, return_index=True)
            stops = np.append(starts[1:], len(leaf))
            who = np.zeros((len(theirs), len(here)), dtype=bool)
            lists = theirs["leaves"].to_numpy()
            asker = np.repeat(np.arange(len(theirs)), [len(x) for x in lists])
            wanted = np.concatenate(lists)
            at = np.searchsorted(here, wanted)
            there = (at < len(here)) & (here[np.minimum(at, len(here) - 1)] == wanted)
            who[asker[there], at[there]] = True
            seen = [(slice(a, b), who[:, i]) for i, (a, b) in enumerate(zip(starts, stops, strict=True))]
            return _frame(_best(theirs["query_id"].to_numpy(), _matrix(theirs["q"]), mine["id"].to_numpy(), _matrix(mine["v"]), k, seen))

        by = ["shelf", "row_block", "query_block"]
        found = rows.groupBy(*by).cogroup(asks.groupBy(*by)).applyInPandas(meet, schema)
        return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_kmeans_tree_search(spark, sf_dir):
    """The 20 nearest found for each vector whose id is divisible by 20, among all other vectors.

    Null, zero and non-finite vectors take no part; repeated query ids ask once, repeated rows are found as often as they come;
    an empty table gives no rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return Index(vectors, k=20).search(vectors.where("vec_id % 20 = 0"))
