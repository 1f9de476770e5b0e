"""Queries that take whole tables, against plain versions over all their rows."""

import hashlib
from difflib import SequenceMatcher

import pytest
from plain_cascade import norm, osa, prefixed
from pyspark.sql import functions as F

from origintrace.functions import ocr
from origintrace.operators import insights, ocr_words
from origintrace.plans import fixtures as fx
from origintrace.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scanned(spark):
    return {r.scan_id: r for r in fx.scans(spark, SF).collect()}


@pytest.fixture(scope="module")
def parts(spark):
    return fx.catalogue(spark, SF).collect()


def test_prefixes_of_every_scan(spark, scanned, parts):
    want = prefixed({i: r.raw_input for i, r in scanned.items()}, {p.search_key for p in parts if not p.is_deleted})
    got = QUERIES["whole_prefix_matches"](spark, SF).collect()
    assert {r.scan_id: r.kind for r in got} == want and len(got) == len(want)
    assert len({i % 10 for i in want}) > 1  # not of one kind of scan only


def test_distances_of_every_scan(spark, scanned, parts):
    keys = {p.ord: p.search_key for p in parts}
    n, lo = len(keys), min(keys)
    users = {i: int(r.user_id[1:]) for i, r in scanned.items()}
    want = {i: osa(norm(r.raw_input), keys[(i * 31 + users[i]) % n + lo]) for i, r in scanned.items()}
    got = QUERIES["whole_marking_distances"](spark, SF).collect()
    assert {r.scan_id: r.distance for r in got} == want and len(got) == len(scanned)
    assert {0, 1, 2} < set(want.values())  # equal, near and far pairs


def test_import_stages_every_row(spark):
    """More rows than 400, with the SQL of another engine; the summary counts the same rows."""
    duckdb = pytest.importorskip("duckdb")
    big = "/root/testdata/sf0.01"
    got = [tuple(r) for r in QUERIES["whole_staged_import"](spark, big).collect()]
    c = duckdb.connect()
    for t in ("part", "lineitem", "supplier", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{big}/{t}.parquet'")
    assert sorted(got) == sorted(c.execute(ORACLE_SQL["whole_staged_import"]).fetchall())
    n = spark.read.parquet(f"{big}/part.parquet").count()
    assert len(got) == n > 400
    count = lambda b: sum(r[2] == b for r in got)
    s = QUERIES["import_summary"](spark, big).first()
    assert s.rows_total == n - count("invalid")
    assert (s.rows_new, s.rows_updated, s.rows_unchanged, s.rows_duplicate) == tuple(map(count, ("new", "updated", "unchanged", "duplicate")))
    assert count("duplicate") > n / 2 and count("new") > n / 20  # both grow with the table


def test_report_places_without_a_global_window(spark, parts):
    """Places equal a sort of all rows, and every window over rows of the catalogue is dealt by range."""
    frame = insights.origin_report(fx.catalogue(spark, SF), "YES")
    rows = [p for p in parts if not p.is_deleted and p.is_chinese == "YES"]
    want = sorted(rows, key=lambda p: (p.criticality != "CRITICAL", p.drone_subsystem, p.component_name, p.component_id))
    got = {r.place: r.component_id for r in frame.collect()}
    assert got == {i + 1: p.component_id for i, p in enumerate(want)} and len(frame.columns) == 10
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number" in line and "windowspec" in line]
    assert windows and all("[range#" in line for line in windows)


def test_digests_gather_no_report(spark):
    """Equal to the joined text's digest, also of null and of no reports, and nothing is collected into one row."""
    rows = [(i, None if i % 5 == 0 else f"d{i % 3}", f"v{i}" if i % 7 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, device string, v string").repartition(5)
    text = lambda d: "".join(f"k={k}|v={v}" for k, g, v in rows if g == d)
    frame = insights.body_digest(df, ["k"], "device")
    assert {r.device: r.digest for r in frame.collect()} == {d: hashlib.sha256(text(d).encode()).hexdigest() for d in (None, "d0", "d1", "d2")}
    assert "collect_list" not in frame._jdf.queryExecution().optimizedPlan().toString()
    none = df.limit(0)
    assert insights.body_digest(none, ["k"]).first().digest == hashlib.sha256(b"").hexdigest() and insights.body_digest(none, ["k"], "device").count() == 0


def test_distinct_parts_gather_no_image(spark):
    """Equal to the fold over each image's words; no image's words are collected into one row."""
    frame = QUERIES["distinct_ocr_parts"](spark, SF)
    words = ocr_words.merged_words(fx.words(spark, SF)).where((ocr.classify_marking(F.col("word")) == "part_number") & (F.length("word") >= 8)).collect()
    want = {}
    for r in sorted(words, key=lambda r: (-r.vote_score, r.word)):
        taken = want.setdefault(r.image_id, [])
        if all(SequenceMatcher(None, r.word, t).ratio() < 0.8 for t in taken):
            taken.append(r.word)
    assert {r.image_id: r.parts for r in frame.collect()} == want
    assert "collect_list" not in frame._jdf.queryExecution().optimizedPlan().toString()
