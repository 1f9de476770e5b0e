"""Search, mixing, sharding, language, archives and URL lists, with odd rows."""

import datetime
import gzip
import hashlib
import math
import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from origintrace.llm import ann, langid, mixing, sharding, url_filters, warc


# --- nearest neighbours ---


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    rows += [(700 + i, rows[40][1]) for i in range(60)]  # ties
    rows += [(900, None), (920, []), (940, [0.0] * 8), (960, [1.0] * 7 + [None]), (980, [float("nan")] + [1.0] * 7), (981, [float("inf")] + [1.0] * 7), (982, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1)).withColumn("id", F.lit(2)), rows


def test_search_finds_the_nearest(vectors):
    df, rows = vectors
    want = plain.nearest([r for r in rows if r[1] is None or len(r[1]) == 8], 20)
    got = {}
    for r in ann.Index(df, k=20, recall=1.0).search(df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hit = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.97 * sum(map(len, want.values()))
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        ordered = sorted(found)
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(ordered, ordered[1:], strict=False))
        assert all(i != q for _, i, _ in found)
    ties = [i for _, i, _ in sorted(got[40]) if i >= 700]
    assert ties == [700 + i for i in range(len(ties))]


def test_default_search_of_clusters(spark):
    """Clustered vectors: few leaves are visited, and what is found is held against brute force."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24)) * 3
    rows = [(i, [float(x) for x in centres[i % 60] + rng.normal(size=24) * 0.4]) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain.nearest(rows, 20)
    index = ann.Index(df, k=20)
    found: dict = {}
    for r in index.search(df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = sum(len(found[q] & {i for i, _ in want[q]}) for q in want) / (20 * len(want))
    assert recall >= 0.95 and index.visits < index.tree.n_leaves / 3 and index.share < 1 / 3


def test_search_blocks_and_repeats(spark, monkeypatch):
    """Tiny shelves and blocks of queries give the same; repeated ids are candidates as often as they come."""
    rng = np.random.default_rng(9)
    rows = [(i % 150, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.Index(df, k=20, recall=1.0)
    one = sorted(index.search(df.where("vec_id % 20 = 0")).collect())
    monkeypatch.setattr(ann, "SHELF_ROWS", 16)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    assert sorted(index.search(df.where("vec_id % 20 = 0")).collect()) == one
    asked = {q: min(v for i, v in rows if i == q) for q in range(0, 150, 20)}
    for q, v in asked.items():
        best = sorted(((-float((np.array(v) * np.array(w)).sum()), i) for i, w in rows if i != q))[:20]
        mine = [(r.score, r.vec_id) for r in one if r.query_id == q]
        assert len(mine) == 20 and len({(round(s, 9), i) for s, i in mine} & {(round(-s, 9), i) for s, i in best}) >= 19


def test_search_of_little(spark, vectors):
    df = vectors[0]
    none = ann.Index(df.where("vec_id < 0"))
    assert none.search(df).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert ann.Index(few).search(few.where("vec_id = 0")).count() == 2


# --- mixing ---


def test_exponent_meets_entropy_and_limit(spark):
    tokens = {"a": 900, "b": 90, "c": 10}
    stats = spark.createDataFrame([(k, v) for k, v in tokens.items()], "mix_source string, source_tokens long")

    def weights(a):
        z = sum((v / 1000) ** a for v in tokens.values())
        return {k: (v / 1000) ** a / z for k, v in tokens.items()}

    a = mixing.solve_exponent(stats, 1000, 1000, target_entropy=0.7)
    assert abs(-sum(w * math.log(w) for w in weights(a).values()) - 0.7) < 1e-6
    a = mixing.solve_exponent(stats, 1000, 1000, max_repeats=3.0)
    assert abs(max(weights(a)[k] * 1000 / tokens[k] for k in tokens) - 3.0) < 1e-6
    assert mixing.solve_exponent(stats, 1000, 5000, max_repeats=3.0) == 1.0


def test_mix_realises_the_weights(spark):
    rows = [(i, "a", 10) for i in range(400)] + [(1000 + i, "b", 7) for i in range(60)] + [(2000 + i, None, 5) for i in range(20)] + [(3000, "d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("mix_block", F.lit("x"))
    out = mixing.mix(df, entropy_gain=0.5, block_tokens=500)
    w = {r.mix_source: r for r in mixing.source_weights(df, entropy_gain=0.5).collect()}
    got = out.collect()
    for name, r in w.items():
        mine = [x for x in got if (x.source or "") == name]
        assert abs(sum(x.n_tokens for x in mine) - r.weight * r.budget) <= 10  # to a document
        copies = {}
        for x in mine:
            copies.setdefault(x.doc_id, []).append(x.mix_epoch)
        assert all(sorted(e) == list(range(len(e))) for e in copies.values())
        assert max(map(len, copies.values())) - min(map(len, copies.values())) <= 1
    blocks = {}
    for x in got:
        blocks.setdefault(x.mix_block, []).append(x)
    for b in blocks.values():
        assert sorted(x.mix_slot for x in b) == list(range(len(b)))
        share = sum(x.n_tokens for x in b if x.source == "a") / sum(x.n_tokens for x in b)
        assert abs(share - w["a"].weight) < 0.08
    assert mixing.mix(df.where("doc_id < 0")).count() == 0


def mix_rows(spark):
    rows = [(i, "a", 5 + i % 7) for i in range(300)] + [(1000 + i, "b", 9) for i in range(40)] + [(2000 + i, None, 4) for i in range(11)]
    rows += [(3000, "d", None)] * 6 + [(None, "b", 3), (None, "b", 3)]  # repeated rows, null counts and ids
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_mix_matches_plain(spark):
    df = mix_rows(spark).where("doc_id is not null and n_tokens is not null")
    seed, buckets = 17, math.isqrt(df.count())
    key = F.xxhash64("doc_id", "source", "n_tokens")
    zero = F.lit(0).cast("long")
    order = df.select("doc_id", F.coalesce("source", F.lit("")), "n_tokens", F.pmod(F.xxhash64(key, zero, F.lit(seed + 1)), F.lit(buckets)), F.xxhash64(key, zero, F.lit(seed)), F.array(*[F.xxhash64(key, zero, F.lit(e), F.lit(seed + 2)) for e in range(8)])).collect()
    want, weights = plain.mixed([tuple(r) for r in order], 0.5, 100.0, 300, buckets)
    got = mixing.mix(df, entropy_gain=0.5, max_repeats=100.0, block_tokens=300).collect()
    assert {(r.doc_id, r.mix_epoch): (r.mix_block, r.mix_slot) for r in got} == want
    assert all(abs(r.mix_weight - weights[r.source or ""]) < 1e-9 for r in got)


def test_mix_depends_on_rows_alone(spark):
    df = mix_rows(spark)
    outs = [sorted(map(str, mixing.mix(d, entropy_gain=0.5, block_tokens=300).collect())) for d in (df.repartition(1), df.repartition(7), df.orderBy(F.desc("n_tokens")))]
    assert outs[0] == outs[1] == outs[2]
    other = sorted(map(str, mixing.mix(df, entropy_gain=0.5, block_tokens=300, seed=18).collect()))
    assert other != outs[0]
    same = [r for r in mixing.mix(df, entropy_gain=0.5, block_tokens=300).collect() if r.doc_id == 3000]
    assert len({(r.mix_epoch, r.mix_block, r.mix_slot) for r in same}) == len(same) >= 6


def test_remix_shows_every_document(docs, clashing):
    out = mixing.remix(clashing.drop("mix_block", "mix_id"), entropy_gain=0.5, max_repeats=3.0)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} and out.count() >= docs.count()


# --- shards ---


def test_hilbert_curve_is_a_path():
    for bits, dims in ((3, 2), (2, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims), axis=-1).reshape(-1, dims)
        index = sharding.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        path = cells[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_are_even_and_gapless(spark, docs, clashing, law):
    rows = clashing.unionByName(clashing.limit(0)).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 16)
    dims = {"source": sharding.quantise_name(F.col("source"), 8), "size": sharding.quantise_log(F.col("size"), 8)}
    got = sharding.hilbert_shards(rows, dims, 4, size="size", tie=["doc_id"], law=law).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in got)


def shard_rows(spark):
    rows = [(i * 7 % 503 if i % 50 else None, "t" * (i % 90), ["en", "fr", None][i % 3], f"s{i % 5}", i % 11) for i in range(500)] + [(900, "same", "en", "s1", 3)] * 8
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    text = F.coalesce("text", F.lit(""))
    df = df.withColumns({"size": (F.octet_length(text) + 16).cast("long"), "text_crc32": F.crc32(text.cast("binary")).cast("long")})
    dims = {"source": sharding.quantise_name(F.col("source"), 8), "lang": sharding.quantise_name(F.col("lang"), 8), "size": sharding.quantise_log(F.col("size"), 8), "id": sharding.quantise_number(F.col("doc_id"), 0, 900, 8)}
    return df, dims


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_match_plain(spark, law):
    """Against a plain walk: sort by the curve and the ties, then cut at equal counts, or at equal bytes."""
    df, dims = shard_rows(spark)
    cells = df.select("doc_id", "size", "text_crc32", *[c.alias(n) for n, c in dims.items()]).collect()
    order = sorted(((plain.hilbert_place([r[3 + i] for i in range(4)], 8), (r.doc_id is not None, r.doc_id or 0), r.text_crc32, r.size, r.doc_id) for r in cells))
    want, at, total, slots = [], 0, len(order) if law == "rows" else sum(x[3] for x in order), {}
    for x in order:
        shard = min(at * 12 // total, 11)
        slots[shard] = slots.get(shard, -1) + 1
        want.append((x[4], x[2], x[0], shard, slots[shard]))
        at += 1 if law == "rows" else x[3]
    got = sharding.hilbert_shards(df, dims, 12, size="size", tie=["doc_id", "text_crc32"], law=law).collect()
    assert sorted(map(str, ((r.doc_id, r.text_crc32, r.hilbert, r.shard, r.slot) for r in got))) == sorted(map(str, want))


def test_written_shards_prune_files(spark, tmp_path):
    """A condition on two dimensions touches few of the files, by their min/max statistics; of files cut by id it touches more."""
    import glob

    import pyarrow.parquet as pq

    df = spark.createDataFrame([(i * 7919 % 2000, i * 7919 % 2000 % 40, i * 7919 % 2000 // 40) for i in range(2000)], "doc_id long, x int, y int").withColumn("n", F.lit(1))
    dims = {"x": sharding.quantise_number(F.col("x"), 0, 39, 6), "y": sharding.quantise_number(F.col("y"), 0, 49, 6)}

    def touched(sharded, name):
        files = glob.glob(f"{sharding.write_shards(sharded, str(tmp_path / name))}/shard=*/*.parquet")
        hit = 0
        for f in files:
            stats = {}
            table = pq.ParquetFile(f)
            for c in ("x", "y"):
                at = table.schema_arrow.names.index(c)
                s = [table.metadata.row_group(g).column(at).statistics for g in range(table.num_row_groups)]
                stats[c] = min(v.min for v in s), max(v.max for v in s)
            hit += stats["x"][0] <= 6 and stats["y"][0] <= 6
        return hit, len(files)

    hit, files = touched(sharding.hilbert_shards(df, dims, 40, size="n", tie=["doc_id"]), "curve")
    plain_hit, _ = touched(sharding.hilbert_shards(df, {"id": sharding.quantise_number(F.col("x"), 0, 39, 6)}, 40, size="n", tie=["doc_id"]), "by-x")
    assert files >= 40 and hit <= 6 < plain_hit or hit < plain_hit / 1.5


def test_shards_of_nothing(empty):
    assert sharding.hilbert_shards(empty, {"a": sharding.quantise_number(F.col("doc_id"), 0, 9, 8)}, 3, size="n_chars", tie=["doc_id"]).count() == 0


# --- language ---


def test_languages_held_out(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    got = langid.identify(docs.where("doc_id % 2 = 1"), model, text="text").collect()
    assert sum(r.lid_lang == r.lang for r in got) >= 0.99 * len(got)


def test_language_of_odd_rows(spark, clashing, empty):
    english = [(100 + i, f"the and of that with which this from {i} there where what", "en", "a", None) for i in range(30)]
    french = [(200 + i, f"les des une dans pour avec cette sont mais {i} nous vous leur", "fr", "b", None) for i in range(30)]
    train = spark.createDataFrame(english + french, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(train)
    got = {r.doc_id: r for r in langid.identify(clashing.unionByName(train, allowMissingColumns=True), model, text="text", declared=F.col("lang"), host=F.col("source")).collect()}
    assert all(got[i].lid_lang == "und" and got[i].lid_confidence == 0 for i in (1, 2, 3))
    assert all(got[100 + i].lid_lang == "en" and got[200 + i].lid_lang == "fr" for i in range(30))
    assert langid.filter_documents(empty).count() == 0
    kept = langid.filter_documents(train.unionByName(train.limit(1).withColumn("text", F.lit(None).cast("string"))))
    assert kept.columns == train.columns and kept.count() == 60


def test_evidence_decides_short_texts(spark):
    """Four in ten texts are one word that all languages have, on declared pages of hosts that keep to a language: what is declared,
    the suffix and the host decide a stated share of all texts, and rightly."""
    r = random.Random(9)
    own = {"en": "the and of that with which this from there".split(), "fr": "les des une dans pour avec cette sont mais".split(), "de": "der und nicht auf mit eine sich auch nach".split()}
    shared = "radio format normal festival hotel".split()
    train = [(i, " ".join(r.choice(words) for _ in range(25)) + " " + " ".join(shared), lang) for i, (lang, words) in enumerate(list(own.items()) * 30)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    rows = []
    for i in range(600):
        lang = ("en", "fr", "de")[i % 3]
        text = r.choice(shared) if i % 10 < 4 else " ".join(r.choice(own[lang]) for _ in range(2 + i % 3))
        rows.append((i, text, lang if i % 9 else None, {"en": "uk", "fr": "fr", "de": "de"}[lang] if i % 8 else "com", f"{lang}{i % 5}.example", "example", lang))
    df = spark.createDataFrame(rows, "id long, t string, d string, s string, h string, m string, true string")
    got = langid.identify(df, model, text="t", declared=F.col("d"), suffix=F.col("s"), host=F.col("h"), domain=F.col("m")).collect()
    decided = [x for x in got if x.lid_lang != x.lid_text_lang]
    right = lambda rows_, c: sum(x[c] == x.true for x in rows_) / len(rows_)
    assert len(decided) >= 0.2 * len(got) and right(decided, "lid_lang") >= 0.95
    assert right(got, "lid_lang") >= 0.95 and right(got, "lid_text_lang") <= 0.8


EVIDENCE = "id long, t string, d string, s string, h string, m string"


def evidence_rows():
    """Plain texts of two languages, and texts that both share, on hosts of one language, with and without declarations."""
    import random

    r = random.Random(4)
    own = {"en": "the and of that with which this from there".split(), "fr": "les des une dans pour avec cette sont mais".split()}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        rows.append((" ".join(r.choice(own[lang]) for _ in range(12)), [lang, lang.upper() + " ", None][i % 3], {"en": "uk", "fr": "fr"}[lang] if i % 5 else None, f"{lang}{i % 4}.example", "example" if i % 7 else None))
    for host, declared, suffix in (("en0.example", None, None), ("fr1.example", None, None), (None, "en", None), (None, "fr", "fr"), (None, None, "uk"), ("new.example", "xx", "zz"), (None, None, None)):
        rows += [("from pour", declared, suffix, host, "example" if host else None), ("from pour", declared, suffix, host, "example" if host else None)]
    rows += [(None, "en", "uk", "en1.example", "example"), (" \n", "fr", None, None, None), ("", None, None, None, None)]
    return [(i, *x) for i, x in enumerate(rows)]


def test_fusion_matches_plain(spark):
    rows = evidence_rows()
    df = spark.createDataFrame(rows, EVIDENCE)
    model = langid.fit(spark.createDataFrame([(i, t, d.strip().lower()) for i, t, d, *_ in rows[:60] if d], "doc_id long, text string, lang string"))
    want = plain.fused_languages(model, [x[1:] for x in rows])
    got = {r.id: r for r in langid.identify(df, model, text="t", declared=F.col("d"), suffix=F.col("s"), host=F.col("h"), domain=F.col("m")).collect()}
    for i, (lang, confidence, alone) in enumerate(want):
        assert (got[i].lid_lang, got[i].lid_text_lang) == (lang, alone) and abs(got[i].lid_confidence - confidence) < 1e-9, i
    decided = [got[60 + 2 * k].lid_lang for k in range(5)]
    assert set(decided) == {"en", "fr"}  # their texts are all alike
    assert len({got[60 + 2 * k].lid_text_lang for k in range(7)}) == 1


def test_ties_take_the_first_language(spark):
    model = langid.Model({"b": np.ones(langid.BINS), "a": np.ones(langid.BINS)})
    (r,) = langid.identify(spark.createDataFrame([("some words",)], "t string"), model, text="t").collect()
    assert r.lid_lang == "a"


def test_every_language_is_kept(spark):
    """More than 64 labels, the last of them rare: one in some thousand rows, all without ids in one of them."""
    import random

    r = random.Random(3)
    names = ["en", *[f"l{i:02}" for i in range(68)], "zz"]
    vocabulary = {n: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 7))) for _ in range(30)] for n in names}
    say = lambda n: " ".join(r.choice(vocabulary[n]) for _ in range(30))
    rows = [(i, say("en"), "en", "h", None) for i in range(9000)]
    rows += [(None if n == "l07" else 10_000 + 10 * k + j, say(n), n, "h", None) for k, n in enumerate(names[1:]) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert langid.fit(docs).languages == [*sorted(names), "und"]
    kept = {(x.lang, x.text) for x in langid.filter_documents(docs).where("lang <> 'en'").collect()}
    assert kept == {(x[2], x[1]) for x in rows if x[2] != "en"}
    rare = spark.createDataFrame([(i, say(n), n) for i, n in enumerate(["zz", "l67", "l07"])], "i int, t string, want string")
    assert all(x.lid_text_lang == x.want for x in langid.identify(rare, langid.fit(docs), text="t").collect())


# --- archives ---

PAGES = [(1, "http://a.example/1", "x" * 1200), (2, "http://a.example/2", "x" * 1200), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1\r\nnot a record" * 60), (9, "a\r\nb", "x" * 1200), (9, "again", "x" * 1200), (None, "n", "x" * 1200), (None, "n", "y" * 1500)]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    back = warc.read_warc(spark, warc.write_warc(pages)).collect()
    assert all(r.kind == "record" for r in back) and len(back) == len(PAGES)
    payload = {p[0]: (p[2] or "").encode() for p in PAGES if p[0] is not None}
    for r in back:
        page = r.record_id.removeprefix("<urn:page:").removesuffix(">")
        if page:
            want = payload[int(page)]
            assert r.payload_digest == hashlib.sha1(want).hexdigest() and r.payload_bytes == len(want)
            assert (r.record_type, r.refers_to) == (("revisit", "<urn:page:9>") if page in "12" else ("response", None))
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0))).count() == 0


def record(body: bytes, digest: bool = True) -> bytes:
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\n" % len(body)
    if digest:
        head += b"WARC-Payload-Digest: sha1:" + hashlib.sha1(body).hexdigest().encode() + b"\r\n"
    return head + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def test_salvage_finds_later_records():
    good = [record(b"a" * n) for n in (10, 20, 30)]
    broken = good[1].replace(b"a" * 20, b"a" * 19 + b"b")
    data = b"junk" + good[0] + broken + good[2] + good[0][:40]
    found = list(warc.salvage(data))
    assert [x[0] for x in found] == ["gap", "record", "gap", "record", "gap"]
    assert [x[1:3] for x in found if x[0] == "gap"] == [(0, 4), (4 + len(good[0]), 4 + len(good[0]) + len(broken)), (len(data) - 40, len(data))]
    assert found[0][1] == 0 and all(a[2] == b[1] for a, b in zip(found, found[1:], strict=False)) and found[-1][2] == len(data)


def test_salvage_of_gzip_members():
    members = [gzip.compress(record(b"m" * n)) for n in (5, 50, 500)]
    bad = bytearray(members[1])
    bad[len(bad) // 2] ^= 0xFF
    data = members[0] + bytes(bad) + members[2]
    found = list(warc.salvage(data))
    assert [x[0] for x in found] == ["record", "gap", "record"] and found[1][1:3] == (len(members[0]), len(members[0]) + len(bad))
    assert list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(members[0][:-3])] == ["gap"]


def test_null_pages_come_back(spark):
    back = warc.read_warc(spark, warc.write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string")))
    nulls = back.where("record_id = '<urn:page:>'").collect()
    assert sorted((r.record_type, r.refers_to) for r in nulls) == [("response", None), ("revisit", "<urn:page:9>")]


def test_long_pages_are_cut_by_bytes(spark, monkeypatch, tmp_path):
    """Pages of more than a MB lie a few a file, small ones together; what is written comes back, plain and as gzip members."""
    monkeypatch.setattr(warc, "FILE_BYTES", 3_000_000)
    noise = random.Random(2)
    pages = [(i, f"http://h/{i}", "".join(noise.choices("abcdefghij <>é", k=1_100_000)) if i % 3 == 0 else f"small {i}") for i in range(12)]
    given = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    for gzipped in (False, True):
        path = warc.write_warc(given, f"file://{tmp_path}/{gzipped}", gzipped=gzipped)
        files = [f for f in (tmp_path / str(gzipped)).iterdir() if f.name.startswith("part-")]
        assert len(files) == 3 and (gzipped or max(f.stat().st_size for f in files) < 3_000_000)
        back = warc.read_warc(spark, path).where("kind = 'record'").select("record_id", "payload_bytes", "payload").collect()
        assert {r.record_id: bytes(r.payload).decode() for r in back} == {f"<urn:page:{i}>": html for i, _, html in pages}
    member = [x for x in warc.salvage((tmp_path / "True" / files[0].name).read_bytes())]
    assert all(x[0] == "record" for x in member)


def test_foreign_revisit_has_no_length(tmp_path, spark):
    head = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: sha1:ABCD\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(head)
    (r,) = warc.read_warc(spark, str(tmp_path)).collect()
    assert (r.kind, r.record_type, r.payload_bytes, r.payload_digest) == ("record", "revisit", None, "ABCD")


def test_salvage_takes_linear_time():
    import random
    import time

    def seconds(data):
        began = time.perf_counter()
        found = list(warc.salvage(data))
        return time.perf_counter() - began, found

    noise = random.Random(1)
    members = [gzip.compress(record(noise.randbytes(5000))) for _ in range(500)]
    broken = (warc.MEMBER + noise.randbytes(400)) * 500  # false starts and nothing else
    lines = b"WARC/1.1\r\n" * 5000
    for part, kind in ((b"".join(members), "record"), (broken, "gap"), (lines, "gap")):
        one, found = seconds(part)
        four, _ = seconds(part * 4)
        assert found[0][0] == kind and four < 12 * one + 0.2


# --- URL lists ---


def test_asof_join_against_plain(spark):
    log = [("bad.example", 10, "add", "x"), ("bad.example", 20, "remove", None), ("bad.example", 30, "add", "y"), ("bad.example", 30, "remove", None), ("sub.bad.example", 5, "add", "z"), ("a.example/p", 0, "add", "page"), (None, 1, "add", "q"), ("k", None, "add", "q")]
    urls = ["http://bad.example/", "https://U:p@www.SUB.bad.example.:80/q?x#y", "http://a.example/p?z", "http://a.example/p/q", "nonsense", None, "http://notbad.example", ""]
    rows = [(i, u, t) for i, u in enumerate(urls) for t in (0, 5, 10, 19, 20, 31)] + [(0, urls[0], 10), (77, urls[0], None)]
    captures = spark.createDataFrame(rows, "key long, url string, fetched_at long")
    entries = spark.createDataFrame(log, "entry string, listed_at long, action string, category string")
    got = url_filters.filter_captures(captures, entries).collect()
    assert len(got) == len(rows)

    def want(url, t):
        spans = {"bad.example": [(10, 20, "x")], "sub.bad.example": [(5, 99, "z")], "a.example/p": [(0, 99, "page")]}
        names = {0: ["bad.example"], 1: ["sub.bad.example", "bad.example"], 2: ["a.example/p"]}.get(urls.index(url), [])
        return next(((n, c) for n in names for a, b, c in spans[n] if t is not None and a <= t < b), (None, None))

    for r in got:
        assert (r.matched, r.category) == want(r.url, r.fetched_at), r
        assert r.blocked == (r.matched is not None)
    assert url_filters.filter_captures(captures.limit(0), entries).count() == 0
    assert url_filters.filter_captures(captures, entries.limit(0)).where("blocked").count() == 0


def test_hosts_of_any_length(spark, clashing):
    """A blocked parent domain counts behind any number of labels, and a URL of a million dots gives few keys."""
    entries = spark.createDataFrame([("bad.example", 0, "add", "x")], "entry string, listed_at long, action string, category string")
    label = "a" * 60
    urls = [f"http://{'.'.join([label] * 5)}.bad.example/", "http://" + "a." * 1_000_000 + "bad.example/", "http://" + "a" * 300, "http://bad.example/" + "p" * 100_000]
    captures = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "key long, url string, fetched_at long").withColumns({c: F.lit("mine") for c in ("entry", "hit", "n", "copies", "host", "category")})
    got = {r.key: r for r in url_filters.filter_captures(captures, entries).collect()}
    assert [got[i].blocked for i in range(4)] == [True, True, False, True]
    assert set(got[0].asDict()) == {"key", "url", "fetched_at", "host", "blocked", "matched", "category", "listed_from"}
    assert captures.select(F.max(F.size(url_filters.lookup_keys(F.col("url"), 11)))).first()[0] <= 8


def test_production_list_is_used(spark):
    import os

    if not os.path.exists("/root/testdata/sf0.01/pages.parquet"):
        pytest.skip("no test tables")
    got = url_filters.op9_url_list_asof(spark, "/root/testdata/sf0.01").groupBy("category").count().collect()
    assert {r.category for r in got} >= {None, "scam", "network", "page"}


def test_no_date_dependence():
    assert datetime.datetime.fromisoformat(warc.CAPTURE_DATE.replace("Z", "+00:00")).year == 2024
