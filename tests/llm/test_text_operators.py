"""Near duplicates, repeated passages, packing and fingerprints against plain versions, with odd rows."""

import hashlib

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from origintrace.llm import components, minhash, packing, spotsigs, suffixes


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_near_duplicates_match_all_pairs(docs, clashing):
    rows = [(d, t) for d, t in pairs(docs) if d is not None]
    want = plain.near_components(rows)
    got = minhash.near_duplicates(clashing).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert want[7][1] == 6 and want[8][1] == 6 and want[5][1] == 4
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_near_duplicates_of_crowds(spark, monkeypatch):
    """A group of edited copies and a passage in many documents, whatever the sizes of blocks and of hot buckets."""
    import random

    from conftest import words

    r, base, passage = random.Random(5), words(50, 100).split(), words(51, 40)
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6])):
            copy[r.randrange(len(copy))] = words(1000 + i, 1)
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, f"{words(3000 + i, 30)} {passage} {words(6000 + i, 30)}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain.near_components(rows)
    for sizes in ({}, {"BLOCK_SHINGLES": 2_000}, {"BLOCK_NODES": 5, "HOT_MEMBERS": 8}):
        for name, value in sizes.items():
            monkeypatch.setattr(minhash, name, value)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(df).collect()}
        assert got == want


def test_keep_first_keeps_columns(docs, clashing):
    kept = minhash.keep_first(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 6 in ids and 7 not in ids and 8 not in ids and 4 in ids and 5 not in ids and ids.count(14) == 2


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=120), st.integers(1, 4))
def test_suffix_order(data, letters):
    text = np.frombuffer(bytes(b % letters + 97 for b in data), dtype=np.uint8)
    raw = text.tobytes()
    order = suffixes.suffix_order(text, 128)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    same = suffixes.common_prefixes(text, order, 8)
    assert same.tolist() == [raw[a : a + 8].ljust(8, b"\0") == raw[b : b + 8].ljust(8, b"\0") for a, b in zip(order, order[1:], strict=False)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=45), min_size=1, max_size=8))
def test_repeats_in_one_array(texts):
    width = 9
    texts = [t.encode() for t in texts]
    doc, start = suffixes.repeats(texts, np.arange(len(texts)), np.zeros(len(texts), dtype=np.int64), width)
    first, want = {}, set()
    for d, t in enumerate(texts):
        for i in range(len(t) - width + 1):
            if first.setdefault(t[i : i + width], (d, i)) != (d, i):
                want.add((d, i))
    assert set(zip(doc.tolist(), start.tolist(), strict=True)) == want


def test_equal_windows_share_anchors():
    from conftest import words

    shared = words(70, 40).encode()[:100]
    texts = [words(71, 30).encode() + shared + words(72, 30).encode(), words(73, 11).encode() + shared + words(74, 50).encode()]
    number, place, h, _ = suffixes.anchors(texts)
    at = [t.index(shared) for t in texts]
    mine = [{(p - at[i], int(x)) for n, p, x in zip(number, place, h, strict=True) if n == i and at[i] <= p <= at[i] + 68} for i in (0, 1)]
    assert mine[0] & mine[1]


@pytest.mark.parametrize("crowding", [{}, {"crowd": 1, "group": 3}])
def test_repeated_passages_match_plain(docs, clashing, crowding):
    rows = [(d, t) for d, t in pairs(docs) if d is not None]
    seen = dict(rows)
    want = plain.repeated_bytes(list(seen.items()))
    done = suffixes.without_repeats(clashing, **crowding)
    assert [c for c in done.columns if not c.startswith("rep_")] == [c for c in clashing.columns if c != "rep_text"]
    got = [r for r in done.collect() if r.doc_id is not None]
    assert len(got) == len(rows)
    for r in got:
        assert (r.rep_bytes, r.rep_removed, r.rep_spans, r.rep_sha256) == want[r.doc_id], r.doc_id
    nulls = [r for r in done.collect() if r.doc_id is None]
    assert sum(r.rep_removed for r in nulls) > 0  # the passage came before


def test_anchors_that_no_task_finds_crowded_are_split(spark, monkeypatch):
    """A phrase in 40 surroundings, fewer than CROWD but more than one suffix array should take; and the same under one crowd mark."""
    from conftest import words

    phrase, passage = words(70, 9), words(71, 30)
    rows = [(i, f"{words(7000 + i, 40)} {phrase} {passage if i % 4 == 0 else ''} {words(8000 + i, 40)}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, split, largest = plain.repeated_bytes(rows), suffixes._split_crowds, []

    def seen(contexts, width, group):
        ready, spans = split(contexts, width, group)
        largest.append((contexts.count(), max([r["count"] for r in ready.groupBy("key").count().collect()], default=0)))
        return ready, spans

    monkeypatch.setattr(suffixes, "_split_crowds", seen)
    for crowding in ({"group": 16}, {"group": 16, "crowd": 8}):
        got = {r.doc_id: (r.rep_bytes, r.rep_removed, r.rep_spans, r.rep_sha256) for r in suffixes.without_repeats(df, **crowding).collect()}
        assert got == want
        assert largest and largest[-1][0] > 16 >= largest[-1][1]
        largest.clear()


def test_remove_repeats_drops_only_what_is_gone(docs):
    left = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    assert 7 not in left and 1 in left and 2 in left and left[6].text is not None and left[11].n_chars == len(left[11].text)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60) | st.text("aBc'sıİßé .,!1²\n\t\x1c\xa0<|>endoftx", max_size=40))
def test_encoder_equals_tokenizer(text):
    e = packing.Encoder.of(packing.tokenizer_path())
    text = text.encode("utf-8", "ignore").decode()
    want = np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert e.ids(text) == want and e.ids(text) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_of_any_tokenizer(name):
    e = packing.Encoder.of(packing.tokenizer_path(name))
    assert e.splits == name.startswith("word")
    for text in ("Hello  World's 12 naïve\n\tlines", "ÉCOLE straße, it's 3.14", "<|endoftext|> a", ""):
        assert e.ids(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packing_matches_plain(docs, clashing):
    from tokenizers import Tokenizer

    rows = [(d, t) for d, t in pairs(docs) if d is not None]
    want = plain.pieces(rows, Tokenizer.from_file(packing.tokenizer_path()))
    got = packing.pack_documents(clashing).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got if r.doc_id is not None} == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_takes_the_tightest_bin(lengths):
    bins, offsets = packing.best_fit(lengths, 40)
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        open_ = [x for x in room if x >= lengths[i]]
        if open_ and lengths[i] < 40:
            room.remove(min(open_))
            room.append(min(open_) - lengths[i])
        else:
            room.append(40 - lengths[i])
        want[i] = None
    used = [0] * (max(bins, default=-1) + 1)
    for b, n in zip(bins, lengths, strict=True):
        used[b] += n
    assert sorted(40 - u for u in used) == sorted(room) and len(want) == len(offsets)


def test_sequences_hold_the_ids(docs):
    packed = packing.pack(packing.tokenised_pieces(docs.where("doc_id in (4, 6, 9)"), packing.tokenizer_path(), with_ids=True))
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4 * r.n_tokens and r.n_tokens <= packing.CAPACITY


COMMON = {w.decode() for w in spotsigs.ANCHORS}


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "und", "de"]) if r.random() < 0.4 else "".join(r.choice("abcdefg") for _ in range(4)) for _ in range(n))


def test_spotsigs_digest(spark, docs, clashing):
    """Against a version of its own: signatures, fingerprints and likenesses, repeated ids by the hash of their texts."""
    from pyspark.sql import functions as F

    more = spark.createDataFrame([(100 + i, f"The {prose(i, 40)}. É Über de l'eau {i}") for i in range(12)] + [(105, prose(77, 30)), (105, prose(78, 30))], "doc_id long, text string")
    df = clashing.where("doc_id is not null").unionByName(more, allowMissingColumns=True)
    order = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).orderBy("doc_id", "h").collect()]
    want = []
    for i, (d, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, following = (plain.spot_signatures(t, COMMON) for t in (text, edited, after))
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain.printed(own), plain.printed(changed), plain.overlap(own, changed), plain.overlap(own, following)))
    got = spotsigs.edited_and_next(df).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_spotsigs_with_null_ids_and_small_buckets(docs, monkeypatch):
    whole = sorted(map(str, spotsigs.edited_and_next(docs).collect()))
    assert len(whole) == docs.count()
    monkeypatch.setattr(spotsigs, "BUCKET_BYTES", 5000)
    assert sorted(map(str, spotsigs.edited_and_next(docs).collect())) == whole


def test_spotsigs_near_duplicates_match_brute_force(spark, docs, clashing):
    r, base = __import__("random").Random(9), prose(1, 150).split()
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(r.choice([0, 1, 3, 8, 15])):
            copy[r.randrange(len(copy))] = prose(200 + i, 1)
        rows.append((500 + i, " ".join(copy)))
    df = clashing.where("doc_id is not null").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    want = plain.spot_components([(x.doc_id, x.text) for x in df.collect()], COMMON)
    got = spotsigs.near_duplicates(df).collect()
    assert len(got) == df.count() and {x.doc_id: (x.n_signatures, x.class_id, x.component_id) for x in got} == want
    assert want[7][1] == 6 and len({c for d, (_, _, c) in want.items() if d >= 500}) < 40


def test_empty_tables(empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert suffixes.without_repeats(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert spotsigs.edited_and_next(empty).count() == 0
    assert spotsigs.near_duplicates(empty).count() == 0


def test_spotsigs_sets_with_much_of_their_own_are_left_out(spark, monkeypatch):
    """Sets are counted in parts of even load, batch by batch, and only those go on that others repeat to the extent of a link."""
    import numpy as np

    r = np.random.default_rng(5)
    common = r.integers(-(1 << 31), 1 << 31, 30)
    sets = {i: sorted({*common[: 5 + i % 26].tolist(), *r.integers(-(1 << 31), 1 << 31, i % 12).tolist()}) for i in range(1200)}
    rows = spark.createDataFrame([(i, len(s), [int(x) for x in s]) for i, s in sets.items()], "node long, n int, sigs array<int>")
    df = __import__("collections").Counter(x for s in sets.values() for x in s)
    want = {i for i, s in sets.items() if 100 * sum(df[x] > 1 for x in s) >= 75 * len(s)}
    for most in (10**6, 500):
        monkeypatch.setattr(spotsigs, "PART_SIGNATURES", most)
        assert {x.node for x in spotsigs.able_nodes(rows).collect()} == want
    assert 0 < len(want) < len(sets)
    places = {x.node: (x.n, len(x.buckets)) for x in spotsigs.meeting_places(spotsigs.able_nodes(rows)).collect()}
    assert places and all(b <= 2 * (n - -(-3 * n // 4) + 1) for n, b in places.values())
