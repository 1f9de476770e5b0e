"""Near-duplicate groups by min-max hashing.

Each permutation's hash gives two signature values, the minimum and the maximum over a document's shingles, so a signature
takes half the hash evaluations; both agree between two sets with the probability of their Jaccard coefficient. Bands of
values propose pairs, and every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few_tasks, flag_listed, free_name, release, small_batches, table
from .components import components

WORDS = 5
PERCENT = 75
#: At a coefficient of 0.75 a pair shares no band with a probability of 2e-5, at 0.85 with one of 6e-11.
BAND_ROWS, BANDS = 5, 40
BLOCK_SHINGLES, BLOCK_NODES = 100_000, 512  # of a block of sets; a task compares two blocks
HOT_MEMBERS, MOST_HOT = 512, 10_000  # a bucket with more members, and more than that part of all, is dealt over several keys; so there are no more than MOST_HOT of these

_MIX = np.random.default_rng(20240101)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WORDS)], dtype=np.uint64)
_A = _MIX.integers(0, 1 << 63, BAND_ROWS * BANDS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _MIX.integers(0, 1 << 63, BAND_ROWS * BANDS // 2, dtype=np.uint64)
_FOLD = _MIX.integers(0, 1 << 63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z in lower case, words end at ASCII white space. A text of
    fewer words has all its words as its one shingle, one without words has none."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in found], dtype=np.uint64)
    n = len(h)
    if n < words:
        return _scramble((h * _POWERS[:n]).sum(keepdims=True) + np.uint64(n))
    code = h[: n - words + 1] * _POWERS[0]
    for k in range(1, words):
        code += h[k : n - words + 1 + k] * _POWERS[k]
    return np.unique(_scramble(code))


def bands(sets: np.ndarray) -> np.ndarray:
    """One hash a band: half of the bands are of minima, half of maxima, of BAND_ROWS different permutations each."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(len(_A), dtype=np.uint64)
    for at in range(0, len(sets), 4096):
        values = sets[None, at : at + 4096] * _A[:, None] + _B[:, None]
        low, high = np.minimum(low, values.min(axis=1)), np.maximum(high, values.max(axis=1))
    rows = np.concatenate([low, high]).reshape(BANDS, BAND_ROWS)
    return _scramble((rows * _FOLD).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (set size), digest (of the set, as hex; null without shingles) and bands."""

    def sign(batches):
        for batch in batches:
            size, digest, band = [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py())
                size.append(len(s))
                digest.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                band.append(bands(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest), pa.array(band, pa.list_(pa.int64()))], names=[key, "n", "digest", "bands"])
        release()

    return small_batches(docs).select(F.col(key).cast("long").alias(key), F.col(text).cast("binary").alias(text)).mapInArrow(sign, f"{key} long, n long, digest string, bands array<long>")


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def make(batches):
        for batch in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=[key, "shingles"])
        release()

    return small_batches(docs).select(F.col(key).cast("long").alias(key), F.col(text).cast("binary").alias(text)).mapInArrow(make, f"{key} long, shingles array<long>")


def _near(n1: str, n2: str, percent: int) -> str:
    return f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2})"


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are near enough."""
    of = lambda name, as_: sets.select(F.col("node").alias(name), F.col("shingles").alias(as_))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    joined = pairs.join(of("a", "sa"), "a").join(of("b", "sb"), "b").withColumn("both", both)
    return cut(joined.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b"), "minhash-links")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: key, n_shingles, class_id (smallest key with the same set), component_id (smallest key reachable by links).

    Rows without words have an empty set, are in no link, and are their own class and component. Rows of equal sets are one
    node, so copies make no pairs. A null key is never a hub or a class's id unless all keys of the class are null; repeated
    keys are separate rows with equal results; an empty table gives an empty one.
    """
    rows = cut(signed(docs, key, text), "minhash-signed")
    classes = cut(rows.where("digest is not null").groupBy("digest").agg(F.min(key).alias("node"), F.min_by(F.struct("n", "bands"), key).alias("s")).selectExpr("digest", "node", "s.n AS n", "s.bands AS bands"), "minhash-classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = flag_listed(docs.select(key, text), key, wanted, "node", "wanted").where("wanted")
        return shingle_sets(wanted.join(texts.withColumnRenamed(key, "node"), "node"), "node", text).dropDuplicates(["node"])

    groups = linked_groups(classes.where("node is not null").selectExpr("node", "n", "bands AS buckets"), sets_of, percent)
    found = classes.select("digest", F.col("node").alias("class_id")).join(groups.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    found = cut(found, "minhash-found")
    out = rows.select(key, F.col("n").alias("n_shingles"), "digest").join(found, "digest", "left")
    return out.select(key, "n_shingles", F.coalesce("class_id", key).alias("class_id"), F.coalesce("component", "class_id", key).alias("component_id"))


def linked_groups(nodes: DataFrame, sets_of, percent: int) -> DataFrame:
    """node, component of the nodes (node, n, buckets) that have a link; sets_of(wanted nodes) gives node, shingles (array<long>).

    In every bucket each node is first compared with one hub only, which joins groups of near copies by stars. Only buckets
    that still hold several components are open; those that hang together through components form a cluster, and a cluster's
    nodes of different components and near sizes are compared in blocks. That is one rule for buckets of every size: none is
    capped, and no link between nodes that share a bucket is missed.

    A bucket's rows are joined under several keys where it is hot, so none is one task's work.
    """
    spread = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    shared = cut(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "minhash-buckets")
    total, largest = shared.agg(F.coalesce(F.sum("members"), F.lit(0)), F.coalesce(F.max("members"), F.lit(0))).first()
    hot = max(HOT_MEMBERS, total // MOST_HOT)
    hot = hot if largest > hot else None
    kept = lambda df, name: cut(few_tasks(df, total), f"minhash-{name}")  # noqa: E731  none of these small tables has more rows than the buckets have members
    members = kept(_dealt_first(spread, shared, hot), "members")
    involved = kept(members.groupBy("node").agg(F.sum("members").alias("company")), "involved")
    sets = cut(sets_of(involved), "minhash-sets")

    # A bucket's hub is the member with the most company in all its buckets: of a group of edited copies, the least edited.
    known = members.join(involved, "node")
    hubs = known.groupBy("bucket").agg(F.max(F.struct("company", -F.col("node"), "n")).alias("h"), F.max("members").alias("members"))
    hubs = kept(hubs.selectExpr("bucket", "members", "-h.col2 AS hub", "h.n AS hub_n"), "hubs")
    to_hub = _dealt(members, hubs, hot).where("node <> hub").where(_near("n", "hub_n", percent)).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = confirmed(to_hub, sets, percent)
    groups = kept(components(links), "groups")

    inside = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = inside.groupBy("bucket").agg(F.max("members").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket", "members", "lo")
    mixed = kept(_dealt(inside, kept(open_, "open"), hot).select("node", "n", "component", "lo"), "mixed")
    more = _compare_in_blocks(mixed, sets, percent) if mixed.take(1) else None
    if more is None or not more.take(1):
        return groups
    # Links between components join these, not nodes: each component's smallest node stands for it.
    for end in ("a", "b"):
        more = more.join(groups.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(end, F.coalesce(f"of_{end}", end)).drop(f"of_{end}")
    joined = kept(components(more), "joined").select(F.col("node").alias("component"), F.col("component").alias("root"))
    found = groups.join(joined, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    alone = joined.join(groups.select(F.col("node").alias("component")), "component", "left_anti")
    return found.unionByName(alone.select(F.col("component").alias("node"), F.col("root").alias("component")))


def _dealt_first(spread: DataFrame, shared: DataFrame, hot: int | None) -> DataFrame:
    """spread's rows of shared buckets, with their members. Rows are told which buckets are hot by a broadcast of those, MOST_HOT at most."""
    if hot is None:
        return spread.join(shared, "bucket")
    listed = shared.where(F.col("members") > hot).select("bucket", F.ceil(F.col("members") / hot).alias("salts"))
    salt = F.coalesce(F.pmod(F.xxhash64("node", F.lit(3)), F.col("salts")), F.lit(0))
    return spread.join(F.broadcast(listed), "bucket", "left").withColumn("salt", salt).drop("salts").join(_every_salt(shared, hot), ["bucket", "salt"]).drop("salt")


def _dealt(members: DataFrame, one: DataFrame, hot: int | None) -> DataFrame:
    """members joined with one row a bucket, both of which know the bucket's size."""
    if hot is None:
        return members.drop("members").join(one, "bucket")
    salt = F.when(F.col("members") > hot, F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("members") / hot))).otherwise(0)
    return members.withColumn("salt", salt.cast("long")).drop("members").join(_every_salt(one, hot), ["bucket", "salt"]).drop("salt")


def _every_salt(one: DataFrame, hot: int) -> DataFrame:
    return one.withColumn("salt", F.explode(F.when(F.col("members") > hot, F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / hot) - 1)).otherwise(F.array(F.lit(0).cast("long")))))


def _compare_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components among the nodes of open buckets (node, n, component, and lo, the bucket's least
    component), compared exactly in blocks.

    Components that buckets connect form a cluster; it is cut into blocks by set size (only blocks of sizes that can link meet),
    component and hash. A component with more than a block is in blocks of its own, and these don't meet each other, so a
    large group that the stars have joined costs its meetings with the cluster's other nodes only. Each pair of blocks is one
    task's work of bounded size, and only links come out, no more than a task has nodes. The work grows with the square of
    what a cluster has left unjoined (copies with so many edits that some are near enough and many just not), and with
    nothing else.
    """
    rows = members.count()
    kept = lambda df, name: cut(few_tasks(df, rows), f"minhash-{name}")
    nodes = kept(members.select("node", "n", "component").distinct(), "open-nodes")
    clusters = components(members.select(F.col("component").alias("a"), F.col("lo").alias("b")).distinct())
    clusters = kept(clusters.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "clusters")
    step = float(np.log(100 / percent))
    placed = nodes.join(clusters, "component").withColumn("level", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    load = lambda of, count: F.ceil(F.greatest(of / BLOCK_SHINGLES, count / BLOCK_NODES)).cast("int")
    own = placed.groupBy("cluster", "level", "component").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c"))
    own = kept(own.withColumn("large", load(F.col("s"), F.col("c"))), "loads")
    pure = own.where("large > 1").select("cluster", "level", F.col("component").alias("only"), F.col("large").alias("blocks"))
    rest = own.where("large = 1").groupBy("cluster", "level").agg(load(F.sum("s"), F.sum("c")).alias("blocks")).select("cluster", "level", F.lit(None).cast("long").alias("only"), "blocks")
    loads = kept(pure.unionByName(rest), "blocks")
    at = placed.join(own.where("large > 1").select("cluster", "level", "component", F.col("component").alias("only")), ["cluster", "level", "component"], "left")
    at = at.join(loads, (at["cluster"] == loads["cluster"]) & (at["level"] == loads["level"]) & at["only"].eqNullSafe(loads["only"])).select(at["cluster"], at["level"], at["only"], "node", "component", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    near = loads.select("cluster", F.col("level").alias("other_level"), F.col("only").alias("other_only"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other_block"))
    mine = F.struct("level", "only", "block")
    other = F.struct(F.col("other_level").alias("level"), F.col("other_only").alias("only"), F.col("other_block").alias("block"))
    meets = (
        at.withColumn("other_level", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)))
        .join(near, ["cluster", "other_level"])
        .where("only is null or other_only is null or only <> other_only")
        .select("cluster", F.least(mine, other).alias("first"), F.greatest(mine, other).alias("second"), "node", "component", (mine <= other).alias("is_first"))
    )

    def compare(pdf):
        import pandas as pd

        pdf = pdf.sort_values("node")
        component, size = pdf["component"].to_numpy(), np.array([len(s) for s in pdf["shingles"]])
        if len(np.unique(component)) < 2:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        row = np.repeat(np.arange(len(pdf)), size)
        token, count = np.unique(np.concatenate(pdf["shingles"].to_numpy()), return_inverse=True, return_counts=True)[1:]
        row, token = row[count[token] > 1], token[count[token] > 1]
        token = np.unique(token, return_inverse=True)[1]
        x, y = np.flatnonzero(pdf["is_first"]), np.flatnonzero(~pdf["is_first"])
        if pdf["first"].iloc[0] == pdf["second"].iloc[0]:
            x = y = np.arange(len(pdf))
        both = np.zeros((len(x), len(y)), dtype=np.float32)
        for at in range(0, int(token.max(initial=-1)) + 1, 2048):
            part = np.zeros((len(pdf), 2048), dtype=np.float32)
            here = (token >= at) & (token < at + 2048)
            part[row[here], token[here] - at] = 1
            both += part[x] @ part[y].T
        near = (100 * both >= percent * (size[x][:, None] + size[y][None, :] - both)) & (component[x][:, None] != component[y][None, :])
        a, b = np.nonzero(near)
        root: dict = {}

        def find(c):
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        node, out = pdf["node"].to_numpy(), []
        for i, j in zip(x[a].tolist(), y[b].tolist(), strict=True):
            u, v = find(component[i]), find(component[j])
            if u != v:  # a link that joins components not joined yet
                root[u] = v
                out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    work = meets.join(sets, "node").select(F.to_json("first").alias("first"), F.to_json("second").alias("second"), "cluster", "node", "component", "is_first", "shingles")
    return cut(work.groupBy("cluster", "first", "second").applyInPandas(compare, "a long, b long"), "minhash-block-links")


def op4_minmax_near_duplicates(spark, sf_dir):
    """Near-duplicate components of all documents.

    A null or wordless text is its own component with an empty set; repeated rows get equal rows; no documents give no rows."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without those that have a smaller doc_id in their component; their own columns, whatever these are called."""
    name = free_name(docs, "kept_id")
    kept = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS shingles FROM w),
s AS (SELECT doc_id, unnest(shingles) AS sh FROM t),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE 100 * both_n >= 75 * (len(x.shingles) + len(y.shingles) - both_n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT doc_id, len(shingles) AS n_shingles, CASE WHEN len(shingles) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(shingles)) END AS class_id FROM t)
SELECT k.doc_id, n_shingles, component_id, k.doc_id = component_id AS kept, class_id FROM k JOIN m ON m.doc_id = k.doc_id
"""
