"""Steps that a larger table changes: rows counted in parts, plans that a size turns, what reaches the driver."""

import random

import numpy as np
import pytest
from plain_cascade import likeness, osa, readings
from pyspark.sql import functions as F

from origintrace.functions import distances
from origintrace.functions import text as X
from origintrace.operators import fuzzy


def grams(key):
    return {key[i : i + 3] for i in range(max(1, len(key) - 2))}


@pytest.mark.parametrize("held", [7, 64, 1 << 16])
def test_blocks_hold_the_rows_that_share_most(monkeypatch, held):
    """Whatever part of the rows is counted at a time, a marking's rows are the first 200 of a full count."""
    monkeypatch.setattr(fuzzy, "HELD_ROWS", held)
    rng = random.Random(3)
    made = lambda: "".join(rng.choice("AB01") for _ in range(rng.randint(1, 9)))
    rows, markings = [made() for _ in range(700)], sorted({made() for _ in range(30)} | {"AB", "é\U0001f600AB", "A" * 400 + "B01"})
    block = fuzzy._Block(markings)
    for at in range(0, len(rows), 50):
        block.add(np.arange(at, at + 50) * 3, rows[at : at + 50])
    found = block.nearest(55.0).to_pylist()
    for m in markings:
        shared = sorted((-len(grams(m) & grams(k)), i) for i, k in enumerate(rows) if grams(m) & grams(k))[:200]
        alike = sorted((-likeness(m, rows[i]), place, i) for place, (_, i) in enumerate(shared) if likeness(m, rows[i]) >= 55)[:5]
        assert [(r["ord"], r["s"], r["r"]) for r in found if r["norm"] == m] == [(i * 3, -s, r + 1) for r, (s, _, i) in enumerate(alike)], m


def test_distances_of_many_pairs():
    rng = random.Random(5)
    made = lambda: "".join(rng.choice("ABé\U0001f600") for _ in range(rng.choice([0, 1, 2, 5, 8, 40])))
    a, b = [made() for _ in range(600)] + ["A" * 3000, ""], [made() for _ in range(600)] + ["AB", "B" * 2000]
    every = np.arange(len(a))
    found, same = distances.osa_and_prefix(distances.Texts.of(a), distances.Texts.of(b), every, every)
    assert found[:600].tolist() == [osa(x, y) for x, y in zip(a[:600], b[:600], strict=True)] and found[600:].tolist() == [2999, 2000]
    assert same.tolist() == [next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))) for x, y in zip(a, b, strict=True)]
    assert distances.similarities(distances.Texts.of([]), distances.Texts.of([]), every[:0], every[:0]).tolist() == []


def test_glyph_tables_are_applied_once_a_key(spark):
    """Re-readings without a lookup of each letter in a map; two tables that say the same of a letter give one."""
    keys = ["", "O", "C8T6", "UVGC0QDO1ILZ25S8B6GFE7T", "A" * 30, "0" * 90]
    frame = spark.createDataFrame([(k,) for k in keys], "k string").select("k", X.glyph_variants(F.col("k")).alias("v"))
    assert all(r.v == readings(r.k) for r in frame.collect())
    assert "map" not in frame._jdf.queryExecution().optimizedPlan().toString().lower().replace("mapobjects", "")


def test_logs_stay_whole_where_a_small_side_is_found_small_while_running(spark):
    """A stored log too large to broadcast by its files, whose ends are few: the join is planned by dealing and carried out without."""
    from origintrace.operators import audit

    from origintrace.session import cut

    events = spark.range(4000).selectExpr(
        "id AS event_key", "concat('u', id % 3) AS actor_id", "'' AS actor_username", "'a' AS action", "'e' AS entity_type", "cast(id AS string) AS entity_id", "'{}' AS detail_json", "'' AS ip_address", "'' AS user_agent",
        "timestamp_seconds(hash(id)) AS occurred_at",
    ).repartition(5)
    schema = events.drop("event_key").schema.add("sequence", "long").add("prev_hash", "string").add("hash", "string")
    first = cut(audit.append(spark.createDataFrame([], schema), events.where("event_key < 2000"), b"k", by="actor_id"), "log")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1b")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        both = cut(audit.append(first, events.where("event_key >= 2000"), b"k", by="actor_id"), "log")
        found = {tuple(r) for r in audit.verify(both, b"k", "actor_id").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert found == {("u0", 1334, True, None), ("u1", 1333, True, None), ("u2", 1333, True, None)}


def test_words_bitmap_comes_in_slices(spark, monkeypatch):
    """Rows that reach the driver are slices of the bitmap, not places of words."""
    from origintrace.llm import spelling

    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: pytest.fail("a row a word"))
    words, bits = sorted({f"word{i}é" * (1 + i % 2) for i in range(3000)}), 1 << 18
    found = spelling._bitmap(spark.createDataFrame([(w,) for w in words], "word string"), bits)
    wanted = np.zeros(bits // 64, dtype=np.uint64)
    for w in words:
        h = int(spelling._scrambled(spelling._hashed(np.frombuffer(w.encode("latin-1"), dtype=np.uint8)[None, :].astype(np.uint64)), bits)[0])
        wanted[h >> 6] |= np.uint64(1 << (h & 63))
    assert (found == wanted).all()


def test_search_index_has_one_posting_a_place_and_short_queries_meet_their_rows_alone(spark, tmp_path):
    """Postings are no more than the texts' characters, and a query of a gram's length or less is met by no other rows."""
    from origintrace.operators import catalogue

    fields = ["component_name", "part_number"]
    texts = [(f"CHIP-{i}", f"Ünit {i * 7919 % 1000:05d}", f"{i * 31 % 977:06d}ab\U0001f600", f"{i}", False) for i in range(400)]
    rows = spark.createDataFrame(texts, "component_id string, component_name string, part_number string, search_key string, is_deleted boolean")
    path = str(tmp_path / "index")
    catalogue.write_search_index(rows, path, fields)
    assert spark.read.parquet(path).count() <= sum(len(t[1]) + len(t[2]) for t in texts)
    asked = ["b\U0001f600", "\U0001f600", "ü", "NIT", "nit 00", "00123", "0012", "t%9", "u_it", "1", " 00", "Ab\U0001f600x", "zz", "0001a", "000%b", "%", ""]
    found = catalogue.search_many(rows, path, spark.createDataFrame([(q,) for q in asked], "query string"), fields)
    key = lambda q: "".join(c for c in q.upper() if c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    like = lambda q, t: __import__("re").search("".join({"%": ".*", "_": "."}.get(c, __import__("re").escape(c)) for c in q.strip().lower()), t.lower())
    want = {(q, i) for q in asked if q.strip("% ") for i, a, b, k, _ in texts if like(q, a) or like(q, b) or (key(q) and k.startswith(key(q)))}
    assert {tuple(r) for r in found.collect()} == want


def test_rows_of_one_key_are_held_once(spark):
    """Keys with more rows than are scanned, levels that end inside a key's rows, rows of several keys in turn."""
    rng = random.Random(9)
    made = lambda n: "".join(rng.choice("AB01") for _ in range(n))
    keys = [made(rng.randint(2, 7)) for _ in range(60)]
    rows = [(i * 2, keys[i % 60] if i % 3 else keys[rng.randrange(7)]) for i in range(1500)]
    markings = sorted({made(rng.randint(1, 8)) for _ in range(50)})
    asked = spark.createDataFrame([(m,) for m in markings], "norm string")
    found = fuzzy.most_similar(asked, spark.createDataFrame(rows, "ord long, search_key string").repartition(5)).collect()
    for m in markings:
        shared = sorted((-len(grams(m) & grams(k)), i, k) for i, k in rows if grams(m) & grams(k))[:200]
        alike = sorted((-likeness(m, k), place, i) for place, (_, i, k) in enumerate(shared) if likeness(m, k) >= 55)[:5]
        assert sorted((r.r, r.ord, r.s) for r in found if r.norm == m) == [(r + 1, i, -s) for r, (s, _, i) in enumerate(alike)], m


@pytest.mark.parametrize("kinds", [64, 2])
def test_markings_without_a_like_key_are_not_dealt(spark, monkeypatch, kinds):
    """The bound by letters keeps every marking that has a like key, and few of those without."""
    monkeypatch.setattr(fuzzy, "KINDS_A_TASK", kinds)
    monkeypatch.setattr(fuzzy, "KINDS_TASKS", 2)
    rng = random.Random(4)
    made = lambda a, b: "".join(rng.choice("ABZ019é") for _ in range(rng.randint(a, b)))
    keys = sorted({"STX" + made(3, 6) for _ in range(80)} | {made(1, 5) for _ in range(20)})
    markings = sorted({made(1, 9) for _ in range(150)} | {"ZZ" + made(5, 8) + "W" for _ in range(50)} | {k[:4] + k[5:] for k in keys if len(k) > 5} | {"7" * 300, "STX" + "9" * 6})
    frame = lambda v, c: spark.createDataFrame([(x,) for x in v], f"{c} string")
    kept = {r.norm for r in fuzzy.resembling(frame(markings, "norm"), frame(keys, "search_key"), 55.0).collect()}
    alike = {m for m in markings if any(likeness(m, k) >= 55 for k in keys)}
    assert alike <= kept and len(kept) < len(markings)
    far = frame([f"ZZ{i * 13}W" for i in range(1000, 3000)], "norm")
    parts = frame([f"STX{i:06d}{('C8T6', 'KCU6', 'BCPZ', 'QFN1')[i % 4]}" for i in range(400)], "search_key")
    assert kinds == 2 or fuzzy.resembling(far, parts, 55.0).count() == 0
    assert fuzzy.resembling(far, parts.where("false"), 55.0).count() == 0


@pytest.mark.parametrize("bits", [1 << 15, 1 << 18])
def test_bitmap_of_hashes_never_misses_one(spark, monkeypatch, bits):
    from origintrace.operators import bitmaps

    monkeypatch.setattr(bitmaps, "LEAST_BITS", bits)
    monkeypatch.setattr(bitmaps, "MOST_BITS", bits)
    hashes = spark.range(3000).select(F.xxhash64("id").alias("h"))
    held = bitmaps.bitmap(hashes, bits)
    wanted = np.zeros(bits, dtype=bool)
    wanted[[r.h % bits for r in hashes.collect()]] = True
    assert (np.unpackbits(held, bitorder="little").astype(bool) == wanted).all()
    lists = spark.range(400).select("id", F.transform(F.sequence(F.col("id") * 20, F.col("id") * 20 + F.col("id") % 20), lambda i: F.xxhash64(i)).alias("l")).unionByName(spark.createDataFrame([(-1, [])], "id long, l array<long>"))
    told = lists.select("id", "l", bitmaps.listed(hashes)(F.col("l")).alias("there")).collect()
    assert all(r.there == [bool(wanted[h % bits]) for h in r.l] for r in told) and {len(r.l) for r in told} == set(range(21))
    assert not any(x for r in lists.select(bitmaps.listed(hashes.where("false"))(F.col("l")).alias("there")).collect() for x in r.there)


def test_only_probes_that_are_looked_up_leave_the_texts(spark):
    """A text has dozens of probes; those without a key in the catalogue reach no join."""
    from origintrace.operators import cascade

    texts = spark.createDataFrame([(i, f"STX{i:06d}C8T6 GQ{i}J") for i in range(300)], "scan_id long, raw_input string")
    keys = spark.createDataFrame([("K", f"STX{i:06d}C8T6") for i in range(0, 300, 3)] + [("B", "X")], "kind string, probe string")
    found = cascade.probes(texts, keys).collect()
    assert {(r.scan_id, r.probe) for r in found if r.kind == "K" and r.layer == cascade.CUT} >= {(i, f"STX{i:06d}C8T6") for i in range(0, 300, 3)}
    assert len(found) < 2 * 300
