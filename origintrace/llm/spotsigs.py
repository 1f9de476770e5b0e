"""SpotSigs fingerprints: at each common-word anchor, a chain of the content words that follow is a signature.

A fingerprint is the sorted set of 32-bit hashes of all signatures, as hex, eight digits each; it covers the whole text.
Likeness is the Jaccard coefficient of two sets, pruned by their lengths.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts, small_batches, table

#: Common words of English, German, French and Spanish that anchor signatures. Fixed values.
ANCHORS = frozenset(
    w.encode()
    for w in """
    a an and are as at be by for from has he in is it its of on or that the this to was were which with you
    aber als auch auf aus das dem den der des die ein eine einen er es für ich im in ist mit nicht sich sie und von war zu
    au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas pour que qui sur un une
    al como con de del el en es la las lo los más no para pero por que se su un una y
    """.split()
)
CHAIN = 2
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000  # text that one task goes through, more where there would be too many; it holds two documents of it at a time
PART_SIGNATURES = 2_000_000  # signatures of all sets that one task counts
#: Letters are kept (A-Z in lower case, bytes from 128 on as they are), the rest separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct hashes of the text's spot signatures.

    A signature is the anchor and the next `chain` content words (words that are no anchors). A text with words but no
    signature so made has one for each run of chain+1 words, or for all its words if it has fewer; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    content, spots = [], []
    for w in words:
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - chain
    made = {b" ".join((w, *content[at : at + chain])) for w, at in spots if at <= last}
    if not made and words:
        made = {b" ".join(words[i : i + chain + 1]) for i in range(max(1, len(words) - chain))}
    return np.array(sorted({xxhash.xxh32_intdigest(s) for s in made}), dtype=np.uint32)


def fingerprint(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard coefficient, or 0 where the lengths alone keep it under floor. Two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < floor * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def with_neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text) dealt and sorted so that each bucket's rows are followed by a guest, the first row of the
    next bucket (of the first bucket, after the last), so a task sees every document's successor without a global window.

    Buckets are ranges of (doc_id, hash of the text) of about BUCKET_BYTES of text each, whatever the input; the driver sees one
    pair a bucket. A null doc_id sorts first; rows of one id are ordered by their texts' hashes, so many of them are many
    buckets' work, and rows equal in both are one bucket's.
    """
    spark = small_batches(docs).sparkSession
    body = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("long").alias("at"), F.xxhash64(body).alias("then"), "doc_id", body.alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    k = max(2 * parts(spark), min(-(-size // BUCKET_BYTES), MOST_BUCKETS))
    ranged = keyed.select("at", "then").repartitionByRange(k, "at", "then").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("at", "then")).alias("first"))
    starts = sorted({(r.at, r.then) for r in ranged.select("first.*").collect()}) or [(0, 0)]
    at_bounds, then_bounds = (np.array(c, dtype=np.int64) for c in zip(*starts, strict=True))

    def buckets_of(at, then):
        """The last bucket whose first pair is not above (at, then), found by the ids and then, among buckets of one id, by the hashes."""
        low, high = np.searchsorted(at_bounds, at, side="left"), np.searchsorted(at_bounds, at, side="right")
        out = high - 1
        for i in np.flatnonzero(high > low):
            out[i] = low[i] + np.searchsorted(then_bounds[low[i] : high[i]], then[i], side="right") - 1
        return out

    def route(batches):
        for batch in batches:
            at, then = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bucket = buckets_of(at, then)
            first = np.flatnonzero((at_bounds[bucket] == at) & (then_bounds[bucket] == then))
            rows = np.concatenate([np.arange(len(at)), first])
            to = np.concatenate([bucket, (bucket[first] - 1) % len(at_bounds)])
            guest = np.arange(len(rows)) >= len(at)
            taken = pa.Table.from_batches([batch]).take(pa.array(rows)) if len(first) else pa.Table.from_batches([batch])
            for c in pa.table({"bucket": pa.array(to.astype(np.int32)), "guest": pa.array(guest), "at": taken.column(0), "then": taken.column(1), "doc_id": taken.column(2), "text": taken.column(3)}).to_batches():
                yield c

    routed = keyed.mapInArrow(route, "bucket int, guest boolean, at long, then long, doc_id long, text string")
    return routed.repartitionById(len(at_bounds), "bucket").sortWithinPartitions("bucket", "guest", "at", "then", "text")


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text and the likeness to that and to the next document."""

    def walk(batches):
        held = None  # bucket, doc_id, text, signatures of the document that waits for its successor
        rows = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 4)]
            for bucket, guest, doc_id, text in zip(*columns, batch.column(5), strict=True):
                if guest and held is None:
                    continue
                text = text.as_py()
                sigs = signatures(text)
                if held is not None:
                    _, own_id, own, own_sigs = held
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    edited_sigs = signatures(edited)
                    rows.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own_sigs), fingerprint(edited_sigs), likeness(own_sigs, edited_sigs), likeness(own_sigs, sigs)))
                held = None if guest else (bucket, doc_id, text, sigs)
                if len(rows) >= 2000:
                    yield flush()
                    rows.clear()
        if rows:
            yield flush()

    return with_neighbours(docs).mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_spotsigs(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts.

    A null text is empty; a null doc_id comes first; repeated rows follow one another; one document is its own successor; no
    documents give no rows."""
    return edited_and_next(table(spark, sf_dir, "documents"))


def signature_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), digest (of the set, as hex; null without signatures) and sigs (array<int>, the hashes' 32 bits)."""

    def make(batches):
        for batch in batches:
            sets = [signatures(t.as_py()) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate([*sets, np.empty(0, dtype=np.uint32)]).view(np.int32)
            digests = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            columns = [batch.column(0), pa.array(np.diff(ends)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", "sigs"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, n int, digest string, sigs array<int>")


def able_nodes(classes: DataFrame, percent: int = 75) -> DataFrame:
    """The classes (node, n, sigs) with so many signatures that other classes have too that they could have a link.

    A link needs at least percent of a set's size in common, so the rest of the search is for sets that are repeated to that
    extent. Signatures are dealt by their value, as arrays, into parts of about PART_SIGNATURES, and a task finds the repeated
    ones of a part. Those that a batch of sets repeats itself are counted there and sent once a batch, so a signature that
    all texts have is no task's load.
    """
    spark = small_batches(classes).sparkSession
    k = max(parts(spark), -(-(classes.agg(F.sum("n")).first()[0] or 0) // PART_SIGNATURES))

    def lists(ends, values):
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))

    def deal(batches):
        for at, batch in enumerate(batches):
            values = batch.column(1).flatten().to_numpy().view(np.uint32)
            nodes = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
            order = np.argsort(values, kind="stable")
            values, nodes = values[order], nodes[order]
            same = values[1:] == values[:-1]
            first, last = np.concatenate([[True], ~same])[: len(values)], np.concatenate([~same, [True]])[: len(values)]
            once, known = first & last, values[first & ~last]
            here, shared = np.unique(nodes[~once], return_counts=True)
            values, nodes = values[once], nodes[once]
            starts = (np.arange(k + 1) << 32) // k  # each part's first value
            mine = np.where(np.arange(k + 1) > at % k, len(here), 0)
            ends, known_ends = np.searchsorted(values, starts), np.searchsorted(known, starts)
            columns = [pa.array(np.arange(k, dtype=np.int32)), lists(ends, nodes), lists(ends, values.view(np.int32)), lists(known_ends, known.view(np.int32)), lists(mine, here), lists(mine, shared)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "nodes", "sigs", "known", "here", "shared"])

    def counted(nodes, r):
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(r, pa.int64())], names=["node", "r"])

    def count(batches):
        nodes, sigs, known = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for batch in batches:
            columns = [c.flatten().to_numpy() for c in batch.columns[1:]]
            for held, c in zip((nodes, sigs, known), columns, strict=False):
                held.append(c)
            yield counted(*columns[3:])
        nodes, sigs, known = (np.concatenate(c) for c in (nodes, sigs, known))
        found, times = np.unique(sigs, return_counts=True)
        yield counted(*np.unique(nodes[np.isin(sigs, np.union1d(found[times > 1], known))], return_counts=True))

    dealt = classes.select("node", "sigs").mapInArrow(deal, "part int, nodes array<long>, sigs array<int>, known array<int>, here array<long>, shared array<long>").repartitionById(k, "part")
    able = dealt.mapInArrow(count, "node long, r long").groupBy("node").agg(F.sum("r").alias("r"))
    return classes.join(able, "node").where(F.col("r") >= F.ceil(F.col("n") * percent / 100.0)).drop("r")


def meeting_places(able: DataFrame, percent: int = 75) -> DataFrame:
    """node, n and buckets (array<long>) such that two linked sets share a bucket.

    A set's length fixes its partition, by powers of 100/percent, and only equal or adjacent partitions can link, so a set is put
    into its own and the next. Inside a partition two linked sets share one of their rarest signatures: of as many as may differ
    from a shorter set, and one, in its own partition; in the next, where it meets longer sets only, of as many as may differ
    from one of its own length, and one. A signature that one set of the partition has alone comes before all others and is no
    place to meet.
    """
    n = F.col("n")
    level = F.floor(F.log(n.cast("double")) / F.lit(float(np.log(100 / percent))) + 1e-9).cast("int")
    own = (n - F.ceil(n * percent / 100.0) + 1).cast("int")
    longer = (n - F.ceil(n * (2 * percent) / (100.0 + percent)) + 1).cast("int")
    places = F.explode(F.array(F.struct(level.alias("part"), own.alias("places")), F.struct((level + 1).alias("part"), longer.alias("places")))).alias("at")
    spread = able.select("node", "n", "sigs", places).select("node", "n", "at.part", "at.places", F.explode("sigs").alias("sig"))
    frequency = cut(spread.groupBy("part", "sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "spotsigs-frequencies")
    ranked = spread.join(frequency, ["part", "sig"]).groupBy("node", "n", "part", "places").agg(F.sort_array(F.collect_list(F.call_function("shiftleft", F.col("df"), F.lit(32)) + F.col("sig"))).alias("ranked"))  # one set's, by df and then by sig
    left = F.greatest(F.col("places") - (n - F.size("ranked")), F.lit(0))
    buckets = F.transform(F.slice("ranked", F.lit(1), left), lambda r: F.xxhash64(r, F.col("part")))
    return ranked.select("node", n.cast("long").alias("n"), buckets.alias("buckets")).where(F.size("buckets") > 0)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_signatures, class_id (smallest id with the very set) and component_id (smallest id reachable by links of at
    least that likeness). Documents without signatures are in no link; a null doc_id is its own class and component unless a
    copy has an id; repeated rows get equal rows; no documents give no rows.

    Equal sets are one class, told by a 128-bit digest. Classes that have too much for themselves are left out at once; the
    others meet in buckets of their rarest signatures, and meetings are compared as full sets, pruned by length.
    """
    from .minhash import linked_groups

    sets = cut(signature_sets(docs), "spotsigs-sets")
    classes = cut(sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("n", "sigs"), "doc_id").alias("s")).selectExpr("digest", "node", "s.n AS n", "s.sigs AS sigs"), "spotsigs-classes")
    able = cut(able_nodes(classes.where("node is not null").select("node", "n", "sigs"), percent), "spotsigs-able")
    nodes = cut(meeting_places(able, percent), "spotsigs-nodes")
    known = able.select("node", F.col("sigs").alias("shingles"))
    groups = linked_groups(nodes, lambda wanted: known.join(wanted.select("node"), "node"), percent)
    found = classes.select("digest", F.col("node").alias("class_id")).join(groups.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    found = cut(found, "spotsigs-found")
    out = sets.select("doc_id", F.col("n").cast("long").alias("n_signatures"), "digest").join(found, "digest", "left")
    return out.select("doc_id", "n_signatures", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "class_id", "doc_id").alias("component_id"))


def spotsigs_near_duplicates(spark, sf_dir):
    """Components of all documents whose spot signatures are three quarters alike."""
    return near_duplicates(table(spark, sf_dir, "documents"))
