"""Imports, files, log, streams and counters."""

import hashlib
import hmac
import json
from collections import deque

from pyspark.sql import functions as F

from origintrace.operators import audit, catalogue, imports, insights, ocr_words
from origintrace.rules import tables as R
from origintrace.sources import readers, sinks
from origintrace.streaming import ingest


def test_header_mapping():
    mapping, left = imports.map_headers(["SER NO", "MAIN COMPONENT", "SUB COMPONENT / CHIP NO", "OEM", "COUNTRY OF ORIGIN", "PHOTOGRAPH / REMARKS", "Manufctr Country", "Odd", "Date Added"])
    assert mapping == {"SER NO": "component_id", "MAIN COMPONENT": "component_name", "SUB COMPONENT / CHIP NO": "chip_number", "OEM": "manufacturer", "COUNTRY OF ORIGIN": "country_of_origin", "PHOTOGRAPH / REMARKS": "remarks", "Manufctr Country": "manufacturer_country"}
    assert left == ["Odd"]


def live_rows(spark, rows):
    cols = R.FIELDS[:-1] + ["confidence_score", "search_key", "revision", "is_deleted"]
    df = spark.createDataFrame(rows, "component_id string, component_name string, part_number string, country_of_origin string, is_chinese string, confidence_score double")
    have = set(df.columns)
    df = df.withColumns({c: F.lit("") for c in cols if c not in have and c not in ("search_key", "revision", "is_deleted")})
    return df.withColumns({"search_key": F.col("part_number"), "revision": F.lit(1), "is_deleted": F.lit(False)}).select(cols)


def test_stage_commit_rollback(spark):
    live = live_rows(spark, [("A", "a", "P1", "France", "NO", 100.0), ("B", "b", "P2", "France", "NO", 100.0), ("C", "c", "P3", "China", "YES", 90.0)])
    raw = spark.createDataFrame([(2, "A", "a", "P1", "France"), (3, "B", "b", "P2", "China"), (4, "D", "d", "P9", "Japan"), (5, "D", "d2", "P9", ""), (6, "E", "", "P8", "Japan"), (7, "", "f", "P7", "")], "row_number int, `Component ID` string, `Component Name` string, `Part No` string, `COO` string")
    staged = imports.stage(raw, live)
    got = {r.row_number: r.bucket for r in staged.collect()}
    assert got == {2: "unchanged", 3: "updated", 4: "new", 5: "duplicate", 6: "invalid", 7: "new"}
    s = imports.summary(staged).first()
    assert (s.rows_total, s.rows_new, s.rows_updated, s.rows_duplicate, s.rows_invalid, s.origin_flips) == (5, 2, 1, 1, 1, 1)
    assert [r[0] for r in imports.missing_in_file(staged, live).collect()] == ["C"]
    version, revisions = imports.commit(live, staged, "b1", delete_missing=True)
    after = {r.component_id: r for r in version.collect()}
    assert after["B"].country_of_origin == "China" and after["B"].is_chinese == "YES" and after["B"].revision == 2 and after["B"].component_name == "b"
    assert after["C"].is_deleted and after["D"].search_key == "P9" and after["A"].revision == 1 and len(after) == 5
    again = imports.stage(raw, version)
    assert {r.row_number: r.bucket for r in again.collect()} == {2: "unchanged", 3: "unchanged", 4: "unchanged", 5: "duplicate", 6: "invalid", 7: "unchanged"}
    back = imports.rollback(version, revisions, "b1")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, live.collect()))


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Name;Note\n\"x;1\";\"say \"\"hi\"\"\nthere\"\n y ;\n".encode())
    got = readers.read_file(spark, str(tmp_path / "a.csv")).orderBy("row_number").collect()
    assert [(r.Name, r.Note, r.row_number) for r in got] == [("x;1", 'say "hi"\nthere', 2), ("y", "", 3)]
    (tmp_path / "b.json").write_text(json.dumps({"components": [{"a": 1, "b": None}, {"a": "x", " c ": True}]}))
    got = readers.read_file(spark, str(tmp_path / "b.json")).orderBy("row_number").collect()
    assert [(r.a, r.b, r.c) for r in got] == [("1", "", ""), ("x", "", "True")]
    (tmp_path / "c.sql").write_text("DROP TABLE t; INSERT INTO `t` (a, `b`) VALUES ('it''s (1), ok', NULL), (2, 'x;y'), (3);\ninsert into t(a,b) values (4,5);")
    got = readers.read_file(spark, str(tmp_path / "c.sql")).orderBy("row_number").collect()
    assert [(r.a, r.b) for r in got] == [("it's (1), ok", ""), ("2", "x;y"), ("4", "5")]
    table = spark.createDataFrame([("x", 1, 2.5), ("y", 2, None)], "name string, n int, v double")
    (tmp_path / "d.xlsx").write_bytes(sinks.xlsx_bytes(table, "A title"))
    got = readers.read_file(spark, str(tmp_path / "d.xlsx")).orderBy("row_number").collect()
    assert [(r["name"], r.n, r.v) for r in got] == [("x", "1", "2.5"), ("y", "2", "")]
    sinks.write_csv(table, str(tmp_path / "out"))
    assert readers.read_delimited(spark, str(tmp_path / "out"), ",").columns[0] == "name"
    assert readers.file_digest(spark, str(tmp_path / "c.sql")).first().sha256 == hashlib.sha256((tmp_path / "c.sql").read_bytes()).hexdigest()


def test_audit_chain(spark):
    schema = "sequence long, actor_id string, actor_username string, action string, entity_type string, entity_id string, detail_json string, ip_address string, user_agent string, occurred_at timestamp, prev_hash string, hash string"
    log = spark.createDataFrame([], schema)
    events = spark.sql("""SELECT id AS event_key, if(id = 2, NULL, 'u') AS actor_id, 'né"w' AS actor_username, 'x' AS action, '' AS entity_type, '' AS entity_id, '{"a": 1}' AS detail_json, '' AS ip_address, '' AS user_agent,
      timestamp_micros(1704067200000000 + id * 1500000) AS occurred_at FROM range(5)""")
    one = audit.append(log, events.where("event_key < 3"), b"k")
    one = spark.createDataFrame(one.collect(), one.schema)
    both = audit.append(one, events.where("event_key >= 3"), b"k")
    rows = sorted(both.collect(), key=lambda r: r.sequence)
    both = spark.createDataFrame(rows, both.schema)
    prev = R.GENESIS
    for r in rows:
        event = {c: r[c] for c in audit.CHAINED} | {"occurred_at": r.occurred_at.isoformat() + "+00:00"}
        want = hmac.new(b"k", (prev + json.dumps(event, sort_keys=True, separators=(",", ":"))).encode(), hashlib.sha256).hexdigest()
        assert (r.prev_hash, r.hash) == (prev, want)
        prev = r.hash
    assert tuple(audit.verify(both, b"k").first()) == (5, True, None)
    bad = both.withColumn("detail_json", F.when(F.col("sequence") == 3, "{}").otherwise(F.col("detail_json")))
    assert tuple(audit.verify(bad, b"k").first()) == (5, False, 3)
    assert tuple(audit.verify(both.where("sequence <> 2"), b"k").first()) == (4, False, 3)
    assert tuple(audit.verify(log, b"k").first()) == (0, True, None)


def test_canonical_text_is_json(spark):
    texts = ["", "plain", 'a"b\\c', "a😀b", "\x7f", "\x00\x01\x1f\n\r\t\f\b/", "né 中 \u2028", "end\n", "\U0010ffff~ !"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", audit._quoted(F.col("t")).alias("q")).collect()
    assert {r.t: r.q for r in got} == {t: json.dumps(t) for t in texts}


def test_many_logs_are_chained_side_by_side(spark):
    events = spark.sql("""SELECT id AS event_key, concat('u', id % 3) AS actor_id, '' AS actor_username, 'x' AS action, '' AS entity_type, cast(id AS string) AS entity_id, '{}' AS detail_json, '' AS ip_address, '' AS user_agent,
      timestamp_seconds(1704067200 + id) AS occurred_at FROM range(20)""")
    empty = events.selectExpr("*", "cast(1 as long) AS sequence", "'' AS prev_hash", "'' AS hash").drop("event_key").where("false")
    early = audit.append(empty, events.where("event_key < 11"), b"k", by="actor_id")
    log = audit.append(spark.createDataFrame(early.collect(), early.schema), events.where("event_key >= 11"), b"k", by="actor_id")
    held = spark.createDataFrame(log.collect(), log.schema)
    assert sorted((r.actor_id, r.sequence) for r in held.collect()) == [(f"u{k}", n) for k in range(3) for n in range(1, 8 - (k == 2))]
    alone = audit.append(empty, events.where("actor_id = 'u1'"), b"k")
    assert {r.entity_id: r.hash for r in alone.collect()} == {r.entity_id: r.hash for r in held.collect() if r.actor_id == "u1"}
    assert {tuple(r) for r in audit.verify(held, b"k", "actor_id").collect()} == {("u0", 7, True, None), ("u1", 7, True, None), ("u2", 6, True, None)}
    bad = held.withColumn("hash", F.when((F.col("actor_id") == "u1") & (F.col("sequence") == 4), "0").otherwise(F.col("hash")))
    assert {tuple(r) for r in audit.verify(bad, b"k", "actor_id").collect()} == {("u0", 7, True, None), ("u1", 7, False, 4), ("u2", 6, True, None)}


def test_first_row_of_an_id_is_seeded(spark):
    rows = spark.createDataFrame([(3, "a", "third"), (1, "a", "first"), (2, "b", "second")], "row_number int, component_id string, component_name string")
    for c in ("country_of_origin", "remarks", "is_chinese", "manufacturer", "chip_number", "part_number"):
        rows = rows.withColumn(c, F.lit(""))
    have = spark.createDataFrame([], "component_id string, component_name string")
    assert sorted((r.component_id, r.component_name) for r in catalogue.seed(have, rows.repartition(3)).collect()) == [("a", "first"), ("b", "second")]


def test_admission_and_lockout(spark):
    assert ingest.admit([0, 1, 2, 61, 62.5], deque(), 2, 60) == [True, True, False, True, True]
    out, state = ingest.lock_steps([(0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (6, True), (70, True)], (0, 0.0), 3, 60)
    assert out == ["failed", "failed", "ok", "failed", "failed", "failed", "locked", "ok"] and state == (0, 0.0)
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", 9, 0.0)], "c string, id long, t double")
    got = {r.id: r.admitted for r in ingest.rate_limited(df, "c", "t", "id", limit=2, window=3.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 9: True}


def test_ingest_stream_is_idempotent(spark, tmp_path):
    rows = [(1, "a", "2024-01-02 00:00:00"), (2, "a", "2024-01-01 00:00:00"), (3, "b", "2023-06-01 00:00:00"), (4, "", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "scan_id long, client_uuid string, at string").withColumn("scanned_at", F.to_timestamp("at"))
    src = str(tmp_path / "in")
    df.write.parquet(src)
    for run in ("1", "2"):  # the second run has a new checkpoint: everything is replayed
        stream = spark.readStream.schema(df.schema).parquet(src)
        ingest.ingest(stream, str(tmp_path / "store"), str(tmp_path / f"cp{run}")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "store"))
    assert sorted((r.scan_id, r.client_uuid) for r in got.collect()) == [(2, "a"), (3, "b")]


def test_queue_adds_up(spark):
    r = spark.createDataFrame([("X", "x1", 1, "not_found"), ("X", "x0", 0, "not_found"), ("Y", "y", 5, "chinese")], "normalized_input string, raw_input string, scanned_at int, result string")
    hits = ingest.queue_hits(r).unionByName(ingest.queue_hits(r.where("raw_input = 'x1'")))
    assert [tuple(x) for x in ingest.queue(hits).collect()] == [("X", 3, "x0", 0)]


def test_ocr_parts(spark):
    rows = [("i", w, 90.0, "e", v, "word", n) for n, (w, v) in enumerate([("STM32F302C8T6", "a"), ("STM32F302C8T6", "b"), ("STM32F3O2C8T6", "a"), ("ADIN1300BCPZ", "a"), ("CHN", "a")])]
    words = spark.createDataFrame(rows, "image_id string, text string, confidence double, engine string, variant string, level string, ord int")
    got = ocr_words.distinct_parts(words).first()
    assert got.multiple and got.parts[0] == "STM32F302C8T6" and len(got.parts) == 2
    assert ocr_words.ranked_candidates(words).where("place = 1").first().word == "STM32F302C8T6"
    assert {r.kind for r in ocr_words.by_class(words).collect()} == {"part_number", "country_of_origin"}
    assert ocr_words.ranked_offline(words).where("place = 1").first().text == "STM32F302C8T6"


def test_catalogue_edits(spark):
    rows = [("A", "Flight controller", "", "CRITICAL", "", "UNKNOWN", False, 1), ("B", "widget", "ESC", "", "", "NO", False, 1)]
    df = spark.createDataFrame(rows, "component_id string, component_name string, drone_subsystem string, criticality string, remarks string, is_chinese string, is_deleted boolean, revision int")
    df = df.withColumns({c: F.lit("") for c in ("criticality_policy", "alternative_manufacturer", "manufacturer", "barcode", "qr_code", "chip_number", "part_number", "category", "military_grade", "country_of_origin")}).withColumn("pending_verification", F.lit(False))
    got = {r.component_id: r for r in catalogue.enrich(df).collect()}
    assert got["A"].drone_subsystem == "Flight Controller" and got["A"].military_grade == "YES" and got["B"].criticality == "NON-CRITICAL" and "ARK-4IN1" in got["B"].alternative_manufacturer
    assert len(got["A"].barcode) == 13 and got["A"].barcode.startswith("890")
    assert catalogue.soft_delete(df, df.where("component_id = 'A'")).where("is_deleted").count() == 1
    assert {r.component_id: r.is_chinese for r in catalogue.edit_country(df, "B", "China").collect()}["B"] == "YES"
    try:
        catalogue.bulk_update(df, df, is_chinese="NO")
        raise AssertionError("must refuse")
    except ValueError:
        pass
    tagged = df.select("component_id", "is_chinese", "component_name").withColumn("row_number", F.lit(1))
    later = tagged.withColumn("is_chinese", F.lit("YES"))
    assert {r.component_id: r.is_chinese for r in catalogue.union_with_precedence([tagged, later]).collect()} == {"A": "YES", "B": "NO"}


def test_insight_details(spark):
    seen = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    want = hashlib.sha256(b"k=a|v=1k=b|v=2").hexdigest()
    assert insights.body_digest(seen, ["k"]).first().digest == want
    signed = insights.sign_inspections(seen, b"s", F.col("k"), F.col("v").cast("string")).collect()
    assert signed[0].signature == hmac.new(b"s", b"a|1", hashlib.sha256).hexdigest()
    numbers = spark.createDataFrame([("INSP-2024-1",), ("INSP-2023-1",)], "inspection_number string")
    assert insights.next_number(numbers, 2024).first()[0] == 2
