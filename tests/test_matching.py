"""Keys, the cascade, verdicts and markings against plain versions and known vectors."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain_cascade import Catalogue, cuts, fold, likeness, norm, osa, readings
from pyspark.sql import functions as F

from origintrace.functions import marking, ocr, origin
from origintrace.functions import text as X
from origintrace.operators import cascade, fuzzy, scans

FIELDS = "ord long, component_id string, component_name string, manufacturer string, country_of_origin string, is_chinese string, category string, drone_subsystem string, criticality string, criticality_policy string, confidence_score double, verified_by string, verification_source string, search_key string, barcode string, qr_code string"


def part(ord_, key, flag="NO", conf=90.0, country="France", category="Chip / IC", maker="Maker", bar="", crit="CRITICAL"):
    return (ord_, f"C{ord_}", f"part {ord_}", maker, country, flag, category, "ESC", crit, "", float(conf), "team", "teardown", key, bar, f"DCOV:C{ord_}")


PARTS = [
    part(0, "STM32F302C8T6", "YES", 95, "China"),
    part(1, "STM32G4A1KCU6", "YES", 98, "China"),
    part(2, "ADIN1300BCPZ", "YES", 90, "China", "Chip / IC"),
    part(3, "ATMEGA16U2", "NO", 90, "USA", bar="8901234567894"),
    part(4, "STM32F405RGT6", "NO", 90),
    part(5, "STM32F405VGT6", "NO", 80),
    part(6, "SHARED100", "YES", 70, "China"),
    part(7, "SHARED100", "NO", 90),
    part(8, "SHARED200", "UNKNOWN", 99, "Unknown"),
    part(9, "SHARED200", "NO", 70),
    part(10, "SHARED200", "NO", 70),
    part(11, "HP", "NO", 85, "USA", "OEM / LRU"),
    part(12, "MX25L12833F", "NO", 90, "Taiwan", maker="Macronix"),
    part(13, "LOWCONF77", "NO", 50),
    part(14, "BLANKORIGIN1", "NO", 90, ""),
    part(15, "ZKEY9988776655", "UNKNOWN", 90, "Unknown"),
]
READS = ["STM32F302C8T6", "stm32 f3o2-c8t6", "STM32G4A1KCU6 GQ23J 1B9U", "ADIN13OOBCPZ", "ATMEGA16U2", "TOTALLY-UNKNOWN-PART-999", "", None, "  ", "8901234567894", "STM32F405", "MX2SLI2833F", "6901234567892",
         "[)>\x1e06\x1d1PSTM32F302C8T6\x1d4LCHN\x1dQ500\x1e\x04", "1PMX25L12833F", "SHARED100", "SHARED200", "HPXYZ", "STM32F40SRGT6", "LOWCONF77", "BLANKORIGIN1", "ZKEY998877665", "ZKEY9989776655", "DCOV:C3", "http://atmega16u2", "ABC", "shared-l00", "[)>\x1e06\x1dQ5\x1e", "ADIN1300BCPZ-R7"]


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame(PARTS, FIELDS)


@pytest.fixture(scope="module")
def matched(spark, catalogue):
    reads = spark.createDataFrame(list(enumerate(READS)), "scan_id long, raw_input string")
    return scans.judged(cascade.match(reads, catalogue)).collect()


def trails(found):
    out = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        out.setdefault(r.scan_id, []).append((r.component_id, r.score, r.method))
    return out


def test_cascade_equals_row_at_a_time(spark, catalogue, matched):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    plain = Catalogue([dict(zip(names, p, strict=True)) for p in PARTS])
    wanted = {i: plain.match(raw) for i, raw in enumerate(READS)}
    got = {r.scan_id: (r.method, r.score, r.component.component_id if r.component else None, r.normalized_input) for r in matched}
    assert got == {i: w[:4] for i, w in wanted.items()}
    reads = spark.createDataFrame(list(enumerate(READS)), "scan_id long, raw_input string")
    assert trails(cascade.trail(cascade.match(reads, catalogue), catalogue).collect()) == {i: w[4] for i, w in wanted.items() if w[4]}


def test_found_keys_and_notes(spark, catalogue, matched):
    """By hand: the key that a marking was found by, and what the match says of it."""
    by = {READS[r.scan_id]: r for r in matched}
    for raw, key, notes in [
        ("STM32G4A1KCU6 GQ23J 1B9U", "STM32G4A1KCU6", ["trailing lot/date code discarded: STM32G4A1KCU6GQ23J1B9U -> STM32G4A1KCU6"]),
        ("stm32 f3o2-c8t6", "STM32F302C8T6", ["OCR correction applied: STM32F3O2C8T6 -> STM32F302C8T6"]),
        ("1PMX25L12833F", "MX25L12833F", ["reel/bag label barcode: manufacturer part number (1P) = MX25L12833F"]),
        ("ADIN13OOBCPZ", "ADIN13OOBCPZ", ["resolved through glyph-class folding (ADIN13OOBCPZ ~ AD1N13008CP2) - verify the marking by eye before accepting"]),
        ("SHARED100", "SHARED100", ["CONFLICT: 2 records share this marking with differing origin verdicts (NO, YES). Manual adjudication required."]),
        ("SHARED200", "SHARED200", ["1 record(s) with unestablished origin superseded by verified record(s)", "2 records share this marking; all agree on origin"]),
        ("STM32F405", "STM32F405", ["2 distinct part numbers share this prefix - confirm manually"]),
        ("HPXYZ", "HPXYZ", ["matched on partial marking (prefix)"]),
        ("8901234567894", "8901234567894", []), ("", "", ["empty input"]),
    ]:
        assert (by[raw].normalized_input, by[raw].notes) == (key, notes), raw
    coo = by["[)>\x1e06\x1d1PSTM32F302C8T6\x1d4LCHN\x1dQ500\x1e\x04"]
    assert coo.normalized_input == "STM32F302C8T6" and len(coo.notes) == 2 and "(4L) = CHN" in coo.notes[1]


def test_all_rows_of_a_hot_key_come_out(spark):
    """A conflict and an agreed key with more rows than a range has; a prefix that many keys share lists ten."""
    rows = [part(i, "HOTKEY1", "YES" if i % 2 else "NO", 50 + i % 7) for i in range(40)] + [part(100 + i, "HOTKEY2", "UNKNOWN" if i % 3 else "NO", i % 5) for i in range(300)] + [part(500 + i, f"MANYKEYS{i:03}") for i in range(60)]
    catalogue = spark.createDataFrame(rows, FIELDS).repartition(7)
    reads = ["HOTKEY1", "hotkey-2", "MANYKEYS", "MANYKEYS0", "HOTKEYI"]
    plain = Catalogue([dict(zip([f.split()[0] for f in FIELDS.split(", ")], p, strict=True)) for p in rows])
    wanted = {i: plain.match(raw) for i, raw in enumerate(reads)}
    matches = cascade.match(spark.createDataFrame(list(enumerate(reads)), "scan_id long, raw_input string"), catalogue)
    found = trails(cascade.trail(matches, catalogue).collect())
    assert found == {i: w[4] for i, w in wanted.items() if w[4]}
    assert [len(found[i]) for i in range(5)] == [40, 99, 10, 10, 40]


def test_known_vectors(matched):
    by = {READS[r.scan_id]: r for r in matched}
    for raw, method, banner in [
        ("STM32F302C8T6", "normalized", "RED"), ("stm32 f3o2-c8t6", "ocr_corrected", "RED"), ("STM32G4A1KCU6 GQ23J 1B9U", "lot_code_stripped", "RED"), ("ADIN13OOBCPZ", "ocr_folded", "RED"),
        ("ATMEGA16U2", "normalized", "GREEN"), ("TOTALLY-UNKNOWN-PART-999", "none", "GREY"), ("", "none", "GREY"), ("8901234567894", "exact_code", "GREEN"), ("STM32F405", "ambiguous_prefix", "GREY"),
        ("MX2SLI2833F", "ocr_folded", "YELLOW"), ("1PMX25L12833F", "label_mpn", "GREEN"), ("SHARED100", "conflict", "GREY"), ("SHARED200", "normalized", "GREEN"), ("LOWCONF77", "normalized", "YELLOW"), ("BLANKORIGIN1", "normalized", "YELLOW"), ("HPXYZ", "prefix", "YELLOW"),
    ]:
        assert (by[raw].method, by[raw].verdict.banner) == (method, banner), raw
    for r in matched:
        v = r.verdict
        if v.banner == "GREEN":
            assert v.origin_evidence == "component" and v.confidence >= 60 and r.method not in ("fuzzy", "prefix", "ocr_folded", "ocr_folded_stripped")
    assert by["STM32F302C8T6"].verdict.escalate and by["ADIN13OOBCPZ"].verdict.headline.startswith("PROBABLE")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("AB0O1S58 -c", max_size=12), st.text("AB0O1S58", max_size=10)), min_size=1, max_size=8))
def test_text_functions(spark, pairs):
    df = spark.createDataFrame([(i, a, norm(a), b) for i, (a, b) in enumerate(pairs)], "i int, raw string, a string, b string")
    for r in fuzzy.similar(df.select(F.col("a").alias("norm"), F.col("b").alias("search_key")).where("norm <> '' and search_key <> ''")).collect():
        assert abs(r.s - likeness(r.norm, r.search_key)) <= 0.011
    alike = [(a, b) for _, a, _, b in ((i, norm(x), None, y) for i, (x, y) in enumerate(pairs)) if a and b and likeness(a, b) >= 55.02]
    assert fuzzy.similar(spark.createDataFrame(alike or [("A", "A")], "norm string, search_key string")).count() == max(1, len(alike))
    cols = {"n": X.normalize(F.col("raw")), "f": X.fold(F.col("a")), "t": X.truncations(F.col("a")), "v": X.glyph_variants(F.col("a")), "d": X.osa_distance(F.col("a"), F.col("b")), "s": X.similarity(F.col("a"), F.col("b"))}
    for r in df.select("a", "b", "raw", *[c.alias(k) for k, c in cols.items()]).collect():
        assert r.n == norm(r.raw) and r.f == fold(r.a) and r.t == cuts(r.a) and r.v == readings(r.a)
        assert r.d == osa(r.a, r.b) and abs(r.s - likeness(r.a, r.b)) <= 0.011


def test_only_touched_texts_are_matched_again(spark, catalogue):
    """Banners that differ between two versions are those of a match of everything; texts that no difference touches aren't matched."""
    changed = [p for p in PARTS if p[0] != 4]
    changed = [(*p[:5], "NO", *p[6:]) if p[0] == 0 else (*p[:13], "MX25L12833G", *p[14:]) if p[0] == 12 else p for p in changed] + [part(40, "TOTALLYUNKNOWNPART99", "YES", 90, "China")]
    later = spark.createDataFrame(changed, FIELDS)
    reads = spark.createDataFrame(list(enumerate(READS)), "scan_id long, raw_input string")
    whole = [{r.scan_id: r.verdict.banner for r in scans.judged(cascade.match(reads, c)).collect()} for c in (catalogue, later)]
    found = {r.scan_id: (r.device_banner, r.server_banner) for r in scans.disagreements(reads, catalogue, later).collect()}
    assert found == {i: (whole[0][i], whole[1][i]) for i in whole[0] if whole[0][i] != whole[1][i]} != {}
    texts = reads.select(F.coalesce("raw_input", F.lit("")).alias("raw_input")).distinct()
    touched = {r.raw_input for r in scans.touched(texts, catalogue, later).collect()}
    assert "SHARED100" not in touched and "ADIN13OOBCPZ" not in touched and "STM32F302C8T6" in touched
    assert scans.touched(texts, catalogue, catalogue).count() == 0 and scans.disagreements(reads, catalogue, catalogue).count() == 0


def test_origin_rules(spark):
    rows = [("China", "", "NO", "NO"), ("", "made in china", "", "YES"), ("Unknown", "", "", "UNKNOWN"), ("--", "", "", "UNKNOWN"), ("Hong Kong", "", "", "YES"), ("TECHNOLAND", "", "", "YES" if "CHN" in "TECHNOLAND" else "NO"), ("France", "", "", "NO"), ("", "", "", "UNKNOWN"), (None, None, None, "UNKNOWN"), ("x", "", "y", "YES")]
    df = spark.createDataFrame(rows, "c string, r string, d string, want string")
    assert all(r.got == r.want for r in df.select("want", origin.derive_origin(F.col("c"), F.col("r"), F.col("d")).alias("got")).collect())
    seed = spark.createDataFrame([("Unknown", "", "NO"), ("TAIWAN/CN", "", "YES"), ("", "COO: China", "YES"), ("", "", "UNKNOWN")], "c string, r string, want string")
    assert all(r.got == r.want for r in seed.select("want", origin.seed_origin(F.col("c"), F.col("r")).alias("got")).collect())


def test_markings(spark):
    maker, key = "ST Microelectronics Inc.", "STM32G491KCU6"
    rows = [
        ("32G491KCU6\nGQ 21U\nCHN 30", "NO", "CHN", ["unit_marked_china_catalogue_non_chinese"], "red"),
        ("32G491KCU6 GQ 21U 9R CHN 30 2B1", "YES", "CHN", ["unit_marked_china"], "red"),
        ("32G491KCU6|PHL", "YES", "PHL", ["country_code_disagrees_with_catalogue"], "yellow"),
        ("32G491KCU6\nGK 99\nPHL", "NO", "PHL", ["site_code_contradicts_country_code"], "red"),
        ("32G491KCU6\nGK 99", "NO", None, ["china_assembly_site_code"], "red"),
        ("32G491KCU6\nY5\nPHL", "NO", "PHL", ["china_wafer_fab_code"], "yellow"),
        ("32G491KCU6\n21U\n9R", "NO", None, ["country_code_missing"], "yellow"),
        ("made in china", "UNKNOWN", "CHN", ["unit_marked_china"], "red"),
        ("", "NO", None, [], "info"),
        (None, None, None, [], "info"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, flag string, code string, found array<string>, w string")
    a = marking.analyse(F.col("t"), F.lit(maker), F.lit(key), F.col("flag"))
    for r in df.select("*", a["country_code"].alias("c"), F.transform(a["findings"], lambda f: f["code"]).alias("f"), a["worst"].alias("x")).collect():
        assert (r.c, r.f, r.x) == (r.code, r.found, r.w), r
    other = df.select(F.size(marking.site_codes(F.col("t"), F.lit("Other"), F.lit(key))).alias("n")).collect()
    assert all(r.n == 0 for r in other)


def test_marking_check_only_tightens(spark, catalogue):
    reads = [(i, raw, text) for i, (raw, text) in enumerate((a, b) for a in ("ATMEGA16U2", "STM32F302C8T6", "LOWCONF77", "NOPE") for b in ("", "CHN", "PHL", "made in china"))]
    df = spark.createDataFrame(reads, "scan_id long, raw_input string, marking_text string")
    rank = {"GREEN": 0, "YELLOW": 1, "RED": 2, "GREY": 3}
    plain = {r.scan_id: r.verdict.banner for r in scans.judged(cascade.match(df, catalogue)).collect()}
    for r in scans.scan_results(df, catalogue).collect():
        assert rank[r.banner] >= rank[plain[r.scan_id]]
        if plain[r.scan_id] == "GREY":
            assert r.banner == "GREY"
    assert {r.banner for r in scans.scan_results(df.where("raw_input = 'ATMEGA16U2' and marking_text = 'CHN'"), catalogue).collect()} == {"RED"}


def test_word_classes(spark):
    want = {"STM32F302C8T6": "part_number", "CHN": "country_of_origin", "made in Malaysia": "country_of_origin", "ST": "vendor", "2219": "date_code", "GQ23": "lot_code", "RoHS": "noise", "": "noise", "!!": "other", "9999": "lot_code"}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.k for r in df.select("t", ocr.classify_marking(F.col("t")).alias("k")).collect()} == want


def test_registered_functions(spark):
    X.register(spark)
    assert spark.sql("SELECT norm_key(' dcov:adin-13oo ') AS a, fold_key('ADIN13OOBCPZ') AS b").first() == ("ADIN13OO", "AD1N13008CP2")
