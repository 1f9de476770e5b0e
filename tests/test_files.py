"""Dumps, dialects, headers, workbooks and fuzzy candidates on small inputs."""

import hashlib
import io
import random
import re
import zipfile

import pytest
from plain_cascade import osa
from pyspark.sql import functions as F

from origintrace.operators import cascade, catalogue, imports
from origintrace.rules import tables as R
from origintrace.sources import readers, sinks

DUMP = """-- INSERT INTO x (a) VALUES ('no');
CREATE TABLE c (a text, b text);
INSERT INTO `c` (`a`, "b") VALUES ('O''Brien', NULL), ('x;(y),', 5), ('short'), (' sp ', 'v');
/* INSERT INTO q (a) VALUES (1); */ UPDATE c SET a='INSERT INTO c (a) VALUES (3)';
insert into [c] ([a]) values (3), (-4.5);"""


def test_dump_rows_are_those_of_insert_statements():
    assert list(readers.insert_rows(DUMP)) == [{"a": "O'Brien", "b": ""}, {"a": "x;(y),", "b": "5"}, {"a": "sp", "b": "v"}, {"a": "3"}, {"a": "-4.5"}]
    assert list(readers.insert_rows("INSERT INTO c (a) VALUES ('open")) == [] == list(readers.insert_rows(""))


def test_dialects():
    assert readers.sniff_offline("\n a;b;c,d\n1,2,3,4,5") == ";" and readers.sniff_offline("plain") == ","
    assert readers.header_row_offline([["title", ""], ["1", "2", "x"], ["Name", "No", "3"]]) == 2


def test_device_likeness_of_headers():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 7))) for _ in range(2))
        want = 1 - osa(a, b) / max(len(a), len(b)) if a and b else 0
        assert imports.edit_likeness(a, b) == pytest.approx(want)
    mapping, left = imports.map_headers(["Part Nubmer", "Remarks", "zzz"], imports.edit_likeness)
    assert mapping == {"Part Nubmer": "part_number", "Remarks": "remarks"} and left == ["zzz"]


def test_workbook_has_provenance_fills_filter_and_digest(spark, tmp_path):
    rows = spark.createDataFrame([("a", "YES", 1.5), ("b", "NO", 2.0), ("c", "UNKNOWN", None)], "component_id string, is_chinese string, score double")
    content = sinks.xlsx_bytes(rows, "Origin report", meta={"generated_at": "2024-01-31", "generated_by": "me", "db_revision": 4}, order=["component_id"])
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sheet, styles = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/styles.xml").decode()
    assert "Generated 2024-01-31 by me | database revision 4 | 3 record(s)" in sheet and 'autoFilter ref="A5:C8"' in sheet and 'ySplit="5"' in sheet
    assert [re.search(rf's="(\d)"><is><t xml:space="preserve">{x}<', sheet).group(1) for x in "abc"] == ["6", "0", "7"] and "FFF8CBAD" in styles
    body = "".join(f"component_id={i}|is_chinese={f}|score={s}" for i, f, s in [("a", "YES", 1.5), ("b", "NO", 2.0), ("c", "UNKNOWN", None)])
    assert hashlib.sha256(body.encode()).hexdigest() in sheet
    with pytest.raises(ValueError):
        sinks.xlsx_bytes(rows, "x", most=2)
    (tmp_path / "r.xlsx").write_bytes(content)
    assert [r["COMPONENT ID"] for r in readers.read_xlsx(spark, str(tmp_path / "r.xlsx")).orderBy("row_number").collect()][:3] == ["a", "b", "c"]


def test_fuzzy_candidates_are_those_of_a_full_count(spark, monkeypatch):
    """Keys that mostly share grams, ties at the last place, and markings that share common grams only."""
    monkeypatch.setattr(R, "FUZZY_SCANNED", 5)
    r = random.Random(6)
    keys = [(i, "STX" + "".join(r.choice("012AB") for _ in range(5)) + r.choice(["C8T6", "QFN1"])) for i in range(120)] + [(500 + i, "ZZ" + str(i) * 3) for i in range(10)]
    markings = ["STX9999", "STXC8T6", "STX012", "ZZ11", "QFN1STX", "0000", "AB012AB", "STX0120QFN1"]
    grams = lambda k: {k[i : i + 3] for i in range(max(1, len(k) - 2))}
    catalogue = spark.createDataFrame(keys, "ord long, search_key string")
    for c in cascade.CARRIED:
        if c != "search_key":
            catalogue = catalogue.withColumn(c, F.lit(0.0) if c == "confidence_score" else F.concat(F.lit(f"{c}-"), F.col("ord").cast("string")))
    scans = spark.createDataFrame([(i, m) for i, m in enumerate(markings)], "scan_id long, norm string")
    got = {x.scan_id: x for x in cascade.fuzzy_layer(scans, catalogue).collect()}
    for i, m in enumerate(markings):
        near = sorted((-len(grams(m) & grams(k)), o, k) for o, k in keys if grams(m) & grams(k))[:5]
        score = lambda k: round((1 - osa(m, k) / max(len(m), len(k))) * 75 + next((j for j, (x, y) in enumerate(zip(m, k, strict=False)) if x != y), min(len(m), len(k))) / max(len(m), len(k)) * 25, 2)  # noqa: B023, E731
        best = sorted((-score(k), place, o) for place, (_, o, k) in enumerate(near) if score(k) >= R.FUZZY_LEAST)
        assert got[i].score == pytest.approx(-best[0][0] if best else 0.0, abs=0.011), m
        assert [x.component_id for x in got[i].suggestions][: 1 if got[i].method != "fuzzy" else 0] == [f"component_id-{o}" for _, _, o in best[:1]][: 1 if got[i].method != "fuzzy" else 0]


def test_workbooks_are_made_in_tasks(spark):
    rows = spark.createDataFrame([(i, f"c{i}", None if i % 3 else "é<&", i % 2 == 0) for i in range(25)], "ord long, name string, note string, flag boolean").repartition(5)
    made = sinks.workbooks(rows, "ord", "Parts", 10)
    assert sorted((r.chunk, r["name"]) for r in made.collect()) == [(k, f"Parts-{k}.xlsx") for k in range(3)]
    back = readers.parse_xlsx(made).collect()
    assert sorted((r["name"], r.note, r.flag) for r in back) == sorted((f"c{i}", "" if i % 3 else "é<&", str(i % 2 == 0)) for i in range(25))
    assert sinks.workbooks(rows.where("false"), "ord", "Parts").count() == 0


def test_only_whole_snapshots_are_taken(spark, tmp_path):
    root = f"file://{tmp_path}/versions"
    rows = spark.createDataFrame([("k", 1)], "search_key string, n int")
    sinks.save_version(rows, root, 3)
    sinks.save_version(rows, root, 7, "import")
    with pytest.raises(Exception, match="boom"):
        sinks.save_version(rows.withColumn("n", F.raise_error(F.lit("boom")).cast("int")), root, 4)
    assert {(r.source, r.version) for r in sinks.manifest(spark, root).collect()} == {("server", 3), ("import", 7)}
    taken = readers.newest(sinks.manifest(spark, root)).first()
    assert (taken.source, taken.version) == ("server", 3) and sinks.read_version(spark, root, taken.version).count() == 1


def test_search_through_postings_is_search(spark, tmp_path):
    parts = [(f"c{i}", name, f"P{i}", "", maker, None, f"89{i:04}", "", f"P{i}", i == 4) for i, (name, maker) in enumerate([("Flight controller", "ACME"), ("ESC 40A", "Acme Inc."), ("éclair", "b_c"), ("100% duty", None), ("Flight gone", "ACME"), ("a", "")])]
    catalogue_ = spark.createDataFrame(parts, "component_id string, component_name string, part_number string, chip_number string, manufacturer string, remarks string, barcode string, supplier string, search_key string, is_deleted boolean")
    index = f"file://{tmp_path}/index"
    catalogue.write_search_index(catalogue_, index)
    asked = ["flight", "ACME", "p3", "P", "É", "é", "zz", "4", "li%ro", "b_c", " acme ", "%", "", "a", "0% d"]
    found = catalogue.search_many(catalogue_, index, spark.createDataFrame([(q,) for q in asked] * 2, "query string"))
    got = {(r["query"], r.component_id) for r in found.collect()}
    assert got == {(q, r.component_id) for q in asked if q.strip("% ") for r in catalogue.search(catalogue_, q).collect()}
    assert found.count() == len(got)
