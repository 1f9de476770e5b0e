"""The stages on odd documents, each against a plain version of it."""

import hashlib
import math
import zlib

import plain
from pyspark.sql import functions as F

import corpus_pipeline as P
from origintrace.llm import langid, packing


def stage(name):
    return dict(P.STAGES)[name]


def test_stages_keep_columns_and_take_effect(spark, docs):
    at = docs
    sizes = {}
    for name, f in P.STAGES[:-1]:
        out = f(spark, at, "")
        assert out.columns == docs.columns
        at = spark.createDataFrame(out.collect(), docs.schema)
        sizes[name] = at.count()
    texts = {r.doc_id: r.text for r in at.collect()}
    assert not {1, 2, 3, 7, 8} & set(texts)
    assert sizes["mixture"] >= sizes["passages"]
    packed = P.STAGES[-1][1](spark, at, "").collect()
    assert {r.doc_id for r in packed} == set(texts) and all(r.offset + r.length <= 4096 for r in packed)


def test_language_stage(spark, docs, clashing):
    model = langid.fit(docs)
    rows = docs.collect()
    found = plain.fused_languages(model, [(r.text, r.lang, None, r.source, None) for r in rows])
    want = sorted(str((r.doc_id, r.text)) for r, (lang, confidence, _) in zip(rows, found, strict=True) if lang != "und" and confidence >= langid.LEAST_CONFIDENCE)
    out = stage("language")(spark, clashing, "")
    assert out.columns == clashing.columns and sorted(str((r.doc_id, r.text)) for r in out.collect()) == want


def test_passage_stage(spark, docs, clashing):
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null and doc_id <> 14").collect()]
    want = plain.repeated_bytes(rows)
    out = stage("passages")(spark, clashing.where("doc_id is not null and doc_id <> 14"), "")
    assert out.columns == clashing.columns
    left = {r.doc_id: r.text for r in out.collect()}
    for d, text in rows:
        n, removed, _, digest = want[d]
        if removed == n and n:
            assert d not in left
        elif removed and text.isascii():
            assert hashlib.sha256(left[d].encode()).hexdigest() == digest
        elif not removed:
            assert left[d] == text


def test_mixture_stage(spark, docs, clashing):
    """Every document at least once; each source's tokens are its weight's part, to a document."""
    out = stage("mixture")(spark, clashing.drop("mix_block", "mix_id"), "")
    copies: dict = {}
    for r in out.collect():
        copies.setdefault(r.source or "", {}).setdefault((r.doc_id, r.text), []).append(1 + len((r.text or "").split()))
    given: dict = {}
    for r in docs.collect():
        given.setdefault(r.source or "", []).append(1 + len((r.text or "").split()))
    total = {s: sum(t) for s, t in given.items()}
    share = {s: t / sum(total.values()) for s, t in total.items()}
    weights = lambda a: {s: p**a / sum(q**a for q in share.values()) for s, p in share.items()}
    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    target = entropy(share) + P.ENTROPY_GAIN * (entropy(weights(0)) - entropy(share))
    repeats = lambda w: max(w[s] / share[s] for s in w) / min(w[s] / share[s] for s in w)
    a = next(i / 1000 for i in range(1001) if entropy(weights(i / 1000)) <= target and repeats(weights(i / 1000)) <= P.MAX_REPEATS)
    w = weights(a)
    least = min(w[s] / share[s] for s in w)
    assert {s: sum(map(len, c.values())) for s, c in copies.items()}.keys() == given.keys()
    for s, c in copies.items():
        assert sum(map(len, c.values())) >= len(given[s])
        assert abs(sum(map(sum, c.values())) - total[s] * w[s] / share[s] / least) <= max(given[s]) + 0.01 * total[s] * 4


def test_packing_stage(spark, docs, clashing):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()]
    want = plain.pieces(rows, Tokenizer.from_file(packing.tokenizer_path()))
    got = stage("sequences")(spark, clashing.where("doc_id is not null"), "").collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    got = packing.pack_documents(docs.where("doc_id is not null"), with_ids=True).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    made = packing.sequences(spark.createDataFrame(got)).collect()
    assert sum(r.n_tokens for r in made) == sum(r.length for r in got) and all(len(r.ids) == 4 * r.n_tokens <= 4 * packing.CAPACITY for r in made)


def test_run_is_the_stages(spark, docs, tmp_path):
    docs.where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    at = docs.where("doc_id is not null")
    for name, f in P.STAGES[:-1]:
        at = spark.createDataFrame(f(spark, at, "").collect(), docs.schema)
    whole = P.run(spark, str(tmp_path))
    key = lambda df: sorted(map(str, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(whole) == key(P.STAGES[-1][1](spark, at, "")) and whole.where(F.col("length") > packing.CAPACITY).count() == 0


def test_near_duplicate_stage(spark, docs):
    some = docs.where("doc_id is not null")
    want = plain.near_components([(r.doc_id, r.text) for r in some.collect()])
    assert {r.doc_id for r in stage("near_duplicates")(spark, some, "").collect()} == {d for d, (_, c) in want.items() if c == d}


def test_empty_corpus(spark, empty):
    at = empty
    for name, f in P.STAGES:
        at = f(spark, at, "")
        assert at.count() == 0
