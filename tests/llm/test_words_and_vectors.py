"""Spelling variants, near vectors and hard negatives against plain versions, on odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from origintrace.llm import negatives, spelling, tiles

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_words(docs, one_in=spelling.TYPO_ONE_IN):
    n = Counter()
    for doc_id, text in docs:
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % one_in == 0 else run] += 1
    return n


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(n, ratio=spelling.RATIO):
    form, near = {}, {}
    for w in n:
        found = [x for x in n if one_edit(w, x)]
        near[w] = len(found)
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], near[w], n.get(form[w])) for w in n}


def spelling_docs():
    r = random.Random(4)
    base = ["".join(r.choice("abéz") for _ in range(r.randint(5, 9))) for _ in range(60)]
    near = base + [w[:i] + w[i + 1 :] for w in base for i in (0, 3)] + [w[:2] + "z" + w[3:] for w in base] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ab×cdé", "abcdef÷"]
    rows = [(i, " ".join(r.choice(near[: 1 + int(len(near) * r.random() ** 2)]) for _ in range(300))) for i in range(40)]
    chain = [("chainaa", 700), ("chainab", 140), ("chainbb", 28), ("chaincb", 5)]
    rows += [(90, " ".join(w for w, k in chain for _ in range(k)))]
    long = "y" * 3000
    return rows + [(50, None), (51, ""), (52, "12 中文 !?"), (None, "ABAZAB abazab ABÉZAB"), (53, rows[0][1].upper()), (0, rows[0][1]), (54, f"{long} " * 6 + f"{long}y " * 40)]


def test_spelling_variants_equal_the_plain_version(spark):
    docs = spelling_docs()
    given = spark.createDataFrame([(*d, "mine", "mine") for d in docs], "doc_id long, text string, word string, run string").repartition(3)
    for one_in in (spelling.TYPO_ONE_IN, 3):
        counted = {r.word: r.n for r in spelling.counted_words(given, one_in=one_in).collect()}
        expected = plain_words(docs, one_in)
        assert {w: k for w, k in counted.items() if w} == {w: k for w, k in expected.items() if w}
    vocabulary = {w: k for w, k in plain_words(docs).items() if len(w) >= 6 and k >= 5}
    found = spelling.variants(spark.createDataFrame(list(vocabulary.items()), "word string, n long"))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()} == plain_variants(vocabulary)
    assert sum(v[0] is not None for v in plain_variants(vocabulary).values()) > 3


def test_spelling_chains_and_empty_vocabulary(spark):
    words = {"chainaa": 700, "chainab": 140, "chainbb": 28, "chainbc": 5, "chainza": 139}
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert [found[w].root for w in ("chainbc", "chainbb", "chainab", "chainaa")] == ["chainaa"] * 4 and found["chainbc"].form == "chainbb"
    assert found["chainza"].n_near == 1
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.counted_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edits_are_distinct_and_whole():
    alphabet = np.array(sorted(map(ord, "abc")), dtype=np.uint64)
    for word in (b"aab", b"abba", b"a", b"cccc"):
        found = [e for _, edited in spelling.edits(np.frombuffer(word, dtype=np.uint8).reshape(1, -1).astype(np.uint64), alphabet, lambda h: np.ones(h.shape, dtype=bool)) for e in edited]
        w, letters = word.decode(), "abc"
        expected = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters if c != w[i]}
        assert len(found) == len(set(found)) and {e.decode() for e in found} == expected


def vectors():
    r = np.random.default_rng(3)
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(r.normal(size=(900, 5)).astype(np.float32))]
    centre = r.normal(size=5)
    rows += [(1000 + i, (centre + 0.18 * r.normal(size=5)).astype(np.float32).tolist(), 1) for i in range(400)]
    rows += [(2000 + i, rows[7][1], 2) for i in range(300)] + [(3000, [x * 4 for x in rows[9][1]], 0)]
    inf, nan = float("inf"), float("nan")
    odd = [None, [0.0] * 5, [1.0, None, 0.0, 0.0, 0.0], [nan] * 5, [1.0, inf, 0.0, 0.0, 0.0], [], [1.0, 2.0], [2.0, 4.0], [-0.0, 0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0, 0.0]]
    rows += [(4000 + i, v, 1) for i, v in enumerate(odd)]
    return rows + [(None, rows[3][1], 1), (5, rows[5][1], 2), (4020, rows[7][1], None)]


def plain_links(rows, least):
    good = [(i, np.array(v, dtype=float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    root = {i: i for i, _ in good}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = []
    for length in {len(v) for _, v in good}:
        same = [(i, v / np.linalg.norm(v)) for i, v in good if len(v) == length]
        g = np.array([v for _, v in same])
        near = g @ g.T >= least
        np.fill_diagonal(near, False)
        links += [(i, int(k)) for (i, _), k in zip(same, near.sum(axis=1), strict=True)]
        for a, b in np.argwhere(near):
            x, y = find(same[a][0]), find(same[b][0])
            root[max(x, y)] = min(x, y)
    out = [(i, k, find(i)) for i, k in links]
    good_ids = Counter(i for i, _ in good)
    for i, _, _ in rows:
        if good_ids[i]:
            good_ids[i] -= 1
        else:
            out.append((i, 0, i))
    return Counter(out)


def test_near_vectors_equal_brute_force(spark):
    rows = vectors()
    given = spark.createDataFrame(rows, VECTORS).withColumnsRenamed({"label": "cid"}).repartition(5)
    found = tiles.near_vectors(given)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == plain_links(rows, tiles.LEAST_COSINE)
    assert tiles.near_vectors(given.where("false")).count() == 0
    doubles = tiles.near_vectors(given.where("vec_id < 1100").select("vec_id", given["embedding"].cast("array<double>").alias("embedding")))
    assert doubles.where("n_links > 0").count() > 50


def test_bounds_hold_and_tiles_decide_alone(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(tiles, "TILE", 7)
    r = np.random.default_rng(8)
    x = tiles._units(np.concatenate([r.normal(size=(30, 6)), np.ones((30, 6)) + 0.3 * r.normal(size=(30, 6))]))
    q, scale, error = tiles.quantised(x)
    exact, about = x @ x.T, (q.astype(int) @ q.T.astype(int)) * scale[:, None] * scale[None, :]
    slack = error[:, None] * (1 + error[None, :]) + error[None, :]
    assert (np.abs(exact - about) <= slack).all() and slack.max() < 0.05
    frame = pd.DataFrame({"cid": np.arange(60), "copies": 1, "q": [v.tobytes() for v in q], "scale": scale, "error": error, "v": list(x)})
    whole = tiles._Side(frame, 6)
    for first, second, same in ((whole, whole, True), (tiles._Side(frame[::2], 6), tiles._Side(frame[1::2], 6), False)):
        bounds, decided = tiles._Found(first, second, same), tiles._Found(first, second, same)
        tiles._meet(first, second, same, 0.9, bounds, False)
        tiles._meet(first, second, same, 0.9, decided, True)
        wanted = exact >= 0.9
        np.fill_diagonal(wanted, False)
        if not same:
            wanted[::2, ::2] = wanted[1::2, 1::2] = False
            wanted = wanted[np.r_[0:60:2, 1:60:2]]
        assert (bounds.links + decided.links == wanted.sum(axis=1)).all() and bounds.open.any() and not bounds.open.all()


def plain_negatives(rows, scale=256):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all():
            x = (label, tuple(math.floor(scale * float(np.float32(c))) for c in v))
            good[i] = min(good.get(i, x), x)
    lengths = Counter(len(v) for _, v in good.values())
    usual = min(lengths, key=lambda n: (-lengths[n], n), default=0)
    good = {i: x for i, x in good.items() if len(x[1]) == usual}
    out = []
    for a, (label, v) in good.items():
        if a % 50:
            continue
        score = {i: sum(p * q for p, q in zip(v, w, strict=True)) for i, (_, w) in good.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if good[i][0] == label][:5]:
            band = [i for i in order if good[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 3000])
def test_hard_negatives_equal_brute_force(spark, scale):
    rows = [(i, v and [x and x * scale for x in v], label) for i, v, label in vectors()]
    given = spark.createDataFrame(rows, VECTORS).withColumn("anchor_id", tiles.F.lit("mine")).repartition(5)
    whole = negatives.whole_rows(given, "vec_id", "label", "embedding")
    found = negatives.hard_negatives(whole, tiles.F.col("id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows) != []
    assert negatives.hard_negatives(negatives.whole_rows(given.where("false"), "vec_id", "label", "embedding"), tiles.F.col("id") % 50 == 0).count() == 0


def test_intervals_keep_the_best_for_every_number_type():
    r = np.random.default_rng(5)
    for size in (200, 1 << 20, 1 << 30):
        rows, anchors = r.integers(-size, size, (500, 6)), r.integers(-size, size, (9, 6))
        kind = negatives.exact_type(anchors, rows)
        ids, scores = np.arange(500), anchors @ rows.T
        left = 0
        for i, found, score in negatives.survivors(anchors, negatives.Planes(rows, kind), np.ones((9, 500), dtype=bool), negatives._can_be_best(4)):
            assert (score == scores[i, found]).all()
            best = negatives._first(found, score, 4)
            assert found[best].tolist() == negatives._first(ids, scores[i], 4).tolist()
            left += len(found)
        assert left < 9 * 60


def test_operators_split_groups_by_blocks(spark):
    """More rows than a block of one label and one direction."""
    n = 9000
    rows = [(i, [float(i % 7), 1.0, 2.0], 1 if i % 100 else 2) for i in range(n)]
    given = spark.createDataFrame(rows, VECTORS)
    found = defaultdict(int)
    for r in tiles.near_vectors(given).collect():
        found[r.vec_id % 7] = max(found[r.vec_id % 7], r.n_links)
    unit = [np.array([k, 1.0, 2.0]) / math.sqrt(k * k + 5) for k in range(7)]
    copies = Counter(i % 7 for i in range(n))
    assert found == {k: sum(copies[m] for m in range(7) if unit[k] @ unit[m] >= 0.95) - 1 for k in range(7)}
    whole = negatives.whole_rows(given, "vec_id", "label", "embedding")
    assert sorted(map(tuple, negatives.hard_negatives(whole, tiles.F.col("id") == 50).collect())) == [x for x in plain_negatives(rows) if x[0] == 50]


def test_spelling_joins_broadcast_nothing(spark, tmp_path):
    """A word's neighbours are many times the vocabulary that Spark sizes them by; neither comes through the driver."""
    r = random.Random(8)
    words = sorted({"".join(r.choice("ab") for _ in range(9)) for _ in range(400)})
    vocabulary = spark.createDataFrame([(w, 1 + i % 50) for i, w in enumerate(words)], "word string, n long")
    plans = []
    write = type(vocabulary.write).parquet
    kept = type(vocabulary.write)
    try:
        kept.parquet = lambda self, path, *a, **b: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, path, *a, **b))[1]
        out = spelling.variants(vocabulary)
        assert out.count() == len(words)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    finally:
        kept.parquet = write
    assert sum("SortMergeJoin" in p for p in plans) > 2 and not any("BroadcastHashJoin" in p or "BroadcastExchange" in p for p in plans)
