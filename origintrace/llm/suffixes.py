"""Exact removal of repeated passages with suffix arrays that are built in two stages.

Inside a task: only suffixes smaller than their successors are sorted directly; a scan over the buckets of first bytes induces
the order of the rest; then common prefixes of neighbours tell which windows of `width` bytes are equal.

Across tasks: anchors (byte strings of ANCHOR bytes that have the least hash of some window) are chosen by content alone, so
equal windows hold the same anchor at the same place. Occurrences of an anchor meet by its hash. Where their surroundings (all
windows that can hold the anchor) are equal as a whole, by a 64-bit hash beside the anchor's own, all but the first occurrence
are repeats as they are, so copies are one piece of text from there on; where they differ, the surroundings' bytes go into
suffix arrays. Only surroundings of one anchor are ever held against each other by hash: with 10**13 of them in groups of a
thousand, the chance that any two differ and have one hash is about 3e-4. A frequent anchor is split: each of its occurrences goes to the longer
strings around it that windows further left and further right must share, halving the windows' range until groups are small.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, flag_listed, parts, release, small_batches, table

WIDTH = 100
ANCHOR = 32
CHUNK_BYTES = 1 << 18  # text hashed at once
HELD_ANCHORS = 120_000  # anchors that a task combines before it passes them on
CROWD = 64  # different surroundings of an anchor among those, from which its occurrences are dealt over keys by their surroundings
GROUP = 512  # surroundings of one key that go into one suffix array; larger groups are split by longer keys, an anchor's too
BLOCK_BYTES = 1 << 18  # text of one suffix array
LAST = (1 << 63) - 1  # null ids come last, by their texts' hashes: up to 2**40 below this


# ---- suffix arrays -------------------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes of the bytes, in order as far as their first `depth` bytes (the end is below all bytes)."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    t = text.astype(np.int16)
    # A suffix is smaller than its successor if the first following byte that differs is larger; the last is larger.
    differs = np.flatnonzero(t[:-1] != t[1:])
    at = np.searchsorted(differs, np.arange(n))
    smaller = np.zeros(n, dtype=bool)
    known = at < len(differs)
    where = differs[at[known]]
    smaller[known] = t[where] < t[where + 1]
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    key = np.ascontiguousarray(rows).view(f"S{depth}").ravel()
    direct = direct[np.argsort(key, kind="stable")]
    first = t[direct]
    heads = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))
    order = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, dtype=np.int64)
        bucket = []
        while len(wave):  # runs of the byte: a suffix that starts with it twice follows the one that starts with it once
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[t[before] == c]
        bucket.append(direct[heads[c] : heads[c + 1]])
        bucket = np.concatenate(bucket)
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        if len(before):
            byte = t[before]
            by = np.argsort(byte, kind="stable")
            byte, before = byte[by], before[by]
            ends = np.flatnonzero(np.diff(byte)) + 1
            for part, b in zip(np.split(before, ends), byte[np.concatenate([[0], ends])], strict=True):
                waiting[b].append(part)
    return np.concatenate(order)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix but the first, in order, whether its first `depth` bytes are those of the one before."""
    padded = np.concatenate([text, np.zeros(depth + 8, dtype=np.uint8)]).astype(np.uint64)
    word = np.zeros(len(text) + depth, dtype=np.uint64)
    for k in range(8):
        word |= padded[k : k + len(word)] << np.uint64(8 * k)
    equal = np.arange(1, len(order))
    for at in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        equal = equal[word[order[equal] + at] == word[order[equal - 1] + at]]
    out = np.zeros(max(0, len(order) - 1), dtype=bool)
    out[equal - 1] = True
    return out


def repeats(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """doc and start of each window of the pieces (piece i is at starts[i] of docs[i]) that an earlier window equals."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    order = suffix_order(text, max(width, 8))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    piece = np.repeat(np.arange(len(pieces)), sizes)
    inside = np.arange(len(text)) - begin[piece]
    order = order[inside[order] + width <= sizes[piece[order]]]  # whole windows only
    if not len(order):
        return docs[:0], starts[:0]
    run = np.concatenate([[0], np.cumsum(~common_prefixes(text, order, width))])
    doc, start = docs[piece[order]], starts[piece[order]] + inside[order]
    by = np.lexsort((start, doc, run))
    run, doc, start = run[by], doc[by], start[by]
    head = np.concatenate([[True], run[1:] != run[:-1]])
    of = np.maximum.accumulate(np.where(head, np.arange(len(run)), 0))
    later = (doc != doc[of]) | (start != start[of])
    return doc[later], start[later]


# ---- anchors -------------------------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _ODD + b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every n neighbours."""
    size = 1
    while 2 * size <= n:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


_BYTE = _join(np.arange(256, dtype=np.uint64) + np.uint64(7), np.full(256, 0x51ED2701, dtype=np.uint64))


def anchors(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the anchors of the texts: text number, place, hash, and hash of the surroundings (place-(width-ANCHOR) to place+width,
    cut off at the text's ends). Texts shorter than width have none."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.empty(0, dtype=np.int64)
    if len(text) < width:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    h, size = _BYTE[text], 1
    while size < ANCHOR:
        h = _join(h[:-size], h[size:])
        size *= 2
    reach = width - ANCHOR  # an anchor starts at most so far after its window
    least = _sliding(h, reach + 1, np.minimum)
    ends = np.repeat(begin[1:], sizes)[: len(least)]
    least = np.where(np.arange(len(least)) + width <= ends, least, 0)  # no windows over the end of a text
    most = _sliding(np.concatenate([np.zeros(reach, dtype=np.uint64), least, np.zeros(reach, dtype=np.uint64)]), reach + 1, np.maximum)[: len(h)]
    at = np.flatnonzero((h == most) & (most > 0))
    number = np.searchsorted(begin, at, side="right") - 1
    place = at - begin[number]
    low, high = at - reach, at + width
    whole = (low >= begin[number]) & (high <= begin[number + 1])
    around = np.zeros(len(at), dtype=np.uint64)
    offsets = [*range(0, reach + width - ANCHOR, ANCHOR), reach + width - ANCHOR]
    full = h[low[whole] + offsets[0]]
    for o in offsets[1:]:
        full = _join(full, h[low[whole] + o])
    around[whole] = full
    for i in np.flatnonzero(~whole):
        lo, hi = max(low[i], begin[number[i]]), min(high[i], begin[number[i] + 1])
        around[i] = xxhash.xxh3_64_intdigest(text[lo:hi].tobytes(), seed=int(at[i] - lo) + 1)
    return number, place, h[at], around


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each doc, overlapping and touching ones joined."""
    by = np.lexsort((start, doc))
    doc, start, stop = doc[by], start[by], stop[by]
    if not len(doc):
        return doc, start, stop
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    group = np.cumsum(new_doc)
    reach = np.maximum.accumulate(stop + group * (1 << 40)) - group * (1 << 40)  # the furthest stop so far, by doc
    head = new_doc.copy()
    head[1:] |= start[1:] > reach[:-1]
    heads = np.flatnonzero(head)
    return doc[heads], start[heads], reach[np.concatenate([heads[1:], [len(doc)]]) - 1]


# ---- the job -------------------------------------------------------------------------------------------------------

OCCURS, REPEATS, MARK = 0, 1, 2
_ROW = pa.schema([("kind", pa.int32()), ("anchor", pa.int64()), ("salt", pa.int32()), ("around", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_DDL = "kind int, anchor long, salt int, around long, doc long, start long, stop long"
_SPAN = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _rows(kind: int, anchor, salt, around, doc, start, stop) -> pa.RecordBatch:
    columns = [np.full(len(doc), kind), anchor, salt, around, doc, start, stop]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


def _around_span(place, length, width):
    return np.maximum(place - (width - ANCHOR), 0), np.minimum(place + width, length)


def _find(width: int, crowd: int):
    """Documents -> anchors' occurrences, combined inside the task. An occurrence has the anchor's place as start and the text's
    length as stop; one whose anchor is crowded here is dealt by its surroundings, and a mark tells the anchor's other rows."""

    def combine(found):
        doc, place, length, anchor, around = (np.concatenate(c) for c in zip(*found, strict=True))
        by = np.lexsort((place, doc, around, anchor))
        doc, place, length, anchor, around = doc[by], place[by], length[by], anchor[by], around[by]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (around[1:] != around[:-1])])
        of = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        later = (doc != doc[of]) | (place != place[of])
        low, high = _around_span(place[later], length[later], width)
        spans = merged(doc[later], low, high)
        if len(spans[0]):
            zero = np.zeros(len(spans[0]), dtype=np.int64)
            yield _rows(REPEATS, spans[0], zero, zero, *spans)
        doc, place, length, anchor, around = doc[new], place[new], length[new], anchor[new], around[new]
        names, which, count = np.unique(anchor, return_inverse=True, return_counts=True)
        crowded = count[which] > crowd
        salt = np.where(crowded, 1 + (around & 0x3FFFFFFF), 0)  # as many keys as surroundings
        yield _rows(OCCURS, anchor, salt, around, doc, place, length)
        crowds = names[count > crowd]
        if len(crowds):
            zero = np.zeros(len(crowds), dtype=np.int64)
            yield _rows(MARK, crowds, zero, zero, zero, zero, zero)

    def find(batches):
        found, held, texts, ids, size = [], 0, [], [], 0

        def scan():
            number, place, anchor, around = anchors(texts, width)
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            return np.array(ids, dtype=np.int64)[number], place, lengths[number], anchor.view(np.int64), around.view(np.int64)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if text is None or len(text) < width:
                    continue
                texts.append(text)
                ids.append(doc)
                size += len(text)
                if size >= CHUNK_BYTES:
                    found.append(scan())
                    held += len(found[-1][0])
                    texts, ids, size = [], [], 0
                    if held >= HELD_ANCHORS:
                        yield from combine(found)
                        found, held = [], 0
        if texts:
            found.append(scan())
        if found:
            yield from combine(found)
        release()

    return find


def _meet(width: int, most: int):
    """Rows of each (anchor, salt) together and in order -> REPEATS spans, and the first occurrence of each surroundings of an
    anchor that has several (OCCURS, with salt 1 if the anchor is crowded, else 0).

    An anchor is crowded if a task found it so, or if more than `most` different surroundings meet here. An anchor that no task
    found crowded has salt 0 alone, so all of its surroundings are counted."""

    def settle(kind, anchor, salt, around, doc, start, stop):
        known = kind == REPEATS
        spans = [(doc[known], start[known], stop[known])]
        rest = ~known
        kind, anchor, salt, around, doc, start, stop = (c[rest] for c in (kind, anchor, salt, around, doc, start, stop))
        if len(kind):
            by = np.lexsort((start, doc, around, kind, salt, anchor))
            kind, anchor, salt, around, doc, start, stop = (c[by] for c in (kind, anchor, salt, around, doc, start, stop))
            group = np.concatenate([[0], np.cumsum((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1]))])
            crowded = (np.bincount(group, kind == MARK) > 0)[group] | (salt > 0)
            seen = kind == OCCURS
            group, anchor, around, doc, start, stop, crowded = (c[seen] for c in (group, anchor, around, doc, start, stop, crowded))
            if len(group):
                new = np.concatenate([[True], (group[1:] != group[:-1]) | (around[1:] != around[:-1])])
                of = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                later = (doc != doc[of]) | (start != start[of])
                low, high = _around_span(start[later], stop[later], width)
                spans.append((doc[later], low, high))
                met = np.bincount(group, new)[group]
                crowded |= met > most
                several = (met > 1) | crowded
                open_ = new & several
                if open_.any():
                    yield _rows(OCCURS, anchor[open_], crowded[open_].astype(np.int64), around[open_], doc[open_], start[open_], stop[open_])
        doc, start, stop = merged(*(np.concatenate(c) for c in zip(*spans, strict=True)))
        if len(doc):
            zero = np.zeros(len(doc), dtype=np.int64)
            yield _rows(REPEATS, zero, zero, zero, doc, start, stop)

    def meet(batches):
        held: list[list[np.ndarray]] = []  # of one (anchor, salt)

        def held_settled():
            return settle(*(np.concatenate(c) for c in zip(*held, strict=True)))

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            anchor, salt = columns[1], columns[2]
            if not len(anchor):
                continue
            other = (anchor != anchor[-1]) | (salt != salt[-1])
            open_from = len(anchor) - np.argmax(other[::-1]) if other.any() else 0
            if open_from:
                held.append([c[:open_from] for c in columns])
            if held and (open_from or held[-1][1][-1] != anchor[-1] or held[-1][2][-1] != salt[-1]):
                yield from held_settled()
                held = []
            held.append([c[open_from:] for c in columns])
        if held:
            yield from held_settled()

    return meet


_CONTEXT = "key long, crowded boolean, doc long, place long, start long, bytes binary, around long"


def _contexts(width: int):
    """(text, doc, places) -> the bytes around each place."""
    names = [x.split()[0] for x in _CONTEXT.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def slice_(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for text, doc, places in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or b""
                for p in places:
                    low, high = max(0, p["start"] - (width - ANCHOR)), min(len(text), p["start"] + width)
                    for column, value in zip(rows, (p["anchor"], p["salt"] > 0, doc, p["start"], low, text[low:high], p["around"]), strict=True):
                        column.append(value)
                if len(rows[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)
                    rows = [[] for _ in names]
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    return slice_


def _arrays(width: int):
    """Surroundings sorted by key -> spans of repeats; whole groups of keys go into suffix arrays of about BLOCK_BYTES."""

    def build(batches):
        pieces, docs, starts, size, last = [], [], [], 0, None

        def found():
            doc, start = repeats(pieces, np.array(docs, dtype=np.int64), np.array(starts, dtype=np.int64), width)
            spans = merged(doc, start, start + width)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in spans], schema=_SPAN)

        for batch in batches:
            for key, doc, start, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= BLOCK_BYTES and key != last:
                    yield found()
                    pieces, docs, starts, size = [], [], [], 0
                last = key
                pieces.append(piece)
                docs.append(doc)
                starts.append(start)
                size += len(piece)
        if pieces:
            yield found()
        release()

    return build


def _split_crowds(contexts: DataFrame, width: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Crowded anchors' surroundings under keys that at most GROUP of them share, and spans found on the way.

    Windows start low to high bytes before the anchor; all of a range hold the bytes from place-low' to place+width-high', so
    their hash is the range's key. Keys that one surroundings has alone are settled; crowded ones have their range halved.
    A range of one window has the window itself as key, so its group is one run of equal windows, whatever its size.
    """
    lo, hi = F.col("lo"), F.col("hi")
    left = F.col("place") - F.col("start")  # bytes before the anchor
    after = F.length("bytes") - left  # from the anchor on
    open_ = contexts.withColumns({"lo": F.lit(0), "hi": F.lit(width - ANCHOR)})
    ready, spans = [], []
    while True:
        middle = F.floor((lo + hi) / 2).cast("int")
        halves = F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), hi.alias("hi")))
        open_ = open_.withColumn("half", F.explode(F.when(lo < hi, halves).otherwise(F.array(F.struct(lo.alias("lo"), hi.alias("hi"))))))
        open_ = open_.withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi")}).drop("half")
        open_ = open_.where((left >= lo) & (after >= F.lit(width) - hi))  # else the range has no window inside this text
        shared = F.substring("bytes", (left - lo + 1).cast("int"), (F.lit(width) - hi + lo).cast("int"))
        keyed = cut(open_.withColumn("key", F.xxhash64(shared, lo, hi)), "suffix-split")
        sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-sizes")
        keyed = keyed.join(sizes, "key")
        single = lo == hi
        ready.append(keyed.where((F.col("n") <= group) & ~single).drop("n", "lo", "hi"))
        window = keyed.where(single).select(shared.alias("window"), "doc", (F.col("place") - lo).alias("start"))
        first = cut(window.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first")), "suffix-first")
        spans.append(window.join(first, "window").where("doc <> first.doc or start <> first.start").select("doc", "start", (F.col("start") + width).alias("stop")))
        open_ = cut(keyed.where((F.col("n") > group) & ~single).drop("n"), "suffix-crowd")
        if not open_.take(1):
            break
    one = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(one(frames[1:]))
    return one(ready).select("key", "doc", "start", "bytes"), one(spans)


def _number(key: str, text: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST) - F.pmod(F.xxhash64(F.col(text).cast("binary")), F.lit(1 << 40)))


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, crowd: int = CROWD, group: int = GROUP) -> DataFrame:
    """doc, start, stop: bytes covered by a window of width bytes that also starts earlier (in a smaller doc, or earlier in the
    same). Spans of a doc may overlap. Rows without a key come last, ordered by a hash of their texts; rows that repeat key and
    text get the same spans, as neither is earlier (a key must not have two texts). Null texts and those shorter than width
    have none."""
    if width < 2 * ANCHOR:
        raise ValueError(f"width must be at least {2 * ANCHOR}")
    spark = small_batches(docs).sparkSession
    rows = docs.select(_number(key, text).alias("doc"), F.col(text).cast("binary").alias(text))
    n = parts(spark)
    occurrences = rows.mapInArrow(_find(width, crowd), _DDL).repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt")
    met = cut(occurrences.mapInArrow(_meet(width, group), _DDL), "suffix-met")
    spans = met.where(F.col("kind") == REPEATS).select("doc", "start", "stop")
    open_ = met.where(F.col("kind") == OCCURS)
    listed = open_.groupBy("doc").agg(F.collect_list(F.struct("anchor", "salt", "around", "start")).alias("places"))  # a doc's, so no more than its text has
    wanted = flag_listed(rows, "doc", open_, "doc", "wanted").where("wanted").drop("wanted")
    contexts = cut(wanted.join(listed, "doc").select(text, "doc", "places").mapInArrow(_contexts(width), _CONTEXT), "suffix-contexts")
    grouped = contexts.where("not crowded").select("key", "doc", "start", "bytes")
    crowded = contexts.where("crowded")
    if crowded.take(1):
        more, found = _split_crowds(crowded.select("doc", "place", "start", "bytes"), width, group)
        grouped, spans = grouped.unionByName(more), spans.unionByName(found)
    arrays = grouped.repartition(n, "key").sortWithinPartitions("key", "doc", "start").mapInArrow(_arrays(width), "doc long, start long, stop long")
    return cut(spans.unionByName(arrays), "suffix-spans")


def _cut_out(text: bytes, spans) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal spans."""
    if not spans:
        return text, 0
    s = np.array([(x["start"], x["stop"]) for x in spans], dtype=np.int64)
    _, start, stop = merged(np.zeros(len(s), dtype=np.int64), s[:, 0], s[:, 1])
    kept, at = [], 0
    for a, b in zip(start.tolist(), stop.tolist(), strict=True):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), len(start)


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, texts: bool = True, **crowding) -> DataFrame:
    """docs' rows with rep_bytes, rep_removed, rep_spans, rep_sha256 (of the kept bytes) and, with texts, rep_text: the kept bytes as
    text, without characters that a cut went through. Other columns stay; those that start with rep_ are replaced.

    Only documents that may have a span (a bitmap of fixed size tells) are shuffled to their spans.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("rep_")])
    spans = repeated_spans(docs, key=key, text=text, width=width, **crowding)
    body = F.coalesce(F.col(text), F.lit(""))
    flagged = flag_listed(docs.withColumn("rep_doc", _number(key, text)), "rep_doc", spans, "doc", "rep_touched")
    plain = flagged.where("not rep_touched").select(*docs.columns, F.octet_length(body).cast("long").alias("rep_bytes"), F.lit(0).cast("long").alias("rep_removed"), F.lit(0).cast("long").alias("rep_spans"), F.sha2(body.cast("binary"), 256).alias("rep_sha256"), *[body.alias("rep_text")] * texts)
    listed = spans.groupBy(F.col("doc").alias("rep_doc")).agg(F.collect_list(F.struct("start", "stop")).alias("rep_list"))
    joined = flagged.where("rep_touched").join(listed, "rep_doc", "left")
    kept_type = "struct<n: long, removed: long, spans: long, sha: string" + (", kept: string>" if texts else ">")

    @F.arrow_udf(kept_type)
    def remove(bodies: pa.Array, lists: pa.Array) -> pa.Array:
        rows = []
        for b, spans in zip(bodies, lists, strict=True):
            body = b.as_py()
            kept, n = _cut_out(body, spans.as_py())
            rows.append({"n": len(body), "removed": len(body) - len(kept), "spans": n, "sha": hashlib.sha256(kept).hexdigest(), **({"kept": kept.decode("utf-8", "ignore")} if texts else {})})
        return pa.array(rows, pa.struct([("n", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("sha", pa.string()), *[("kept", pa.string())] * texts]))

    done = joined.withColumn("rep_done", remove(body.cast("binary"), F.col("rep_list")))
    names = {"rep_bytes": "n", "rep_removed": "removed", "rep_spans": "spans", "rep_sha256": "sha", **({"rep_text": "kept"} if texts else {})}
    return plain.unionByName(done.select(*docs.columns, *[F.col(f"rep_done.{v}").alias(k) for k, v in names.items()]))


def op6_suffix_dedup(spark, sf_dir):
    """What is left of every document when passages of 100 bytes that occur earlier are taken out.

    A null text is empty; null doc_ids come last; rows repeated in id and text get equal rows; no documents give no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = without_repeats(docs, texts=False)
    return done.select("doc_id", F.col("rep_bytes").alias("n_bytes"), F.col("rep_removed").alias("n_removed"), F.col("rep_spans").alias("n_spans"), F.col("rep_sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages taken out of their texts (and n_chars counted again); documents with nothing left go."""
    done = without_repeats(docs)
    gone = (F.col("rep_removed") > 0) & (F.length("rep_text") == 0)
    text = F.when(F.col("rep_removed") > 0, F.col("rep_text")).otherwise(F.col("text"))
    done = done.where(~gone).withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("rep_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
