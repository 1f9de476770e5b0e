"""Queries of edits, listings, imports and seeds: what changes or pages the catalogue, the scans and the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import origin
from ..functions import text as X
from ..operators import catalogue, imports, insights, ocr_words
from ..rules import tables as R
from ..session import scratch_path
from ..streaming import ingest
from . import fixtures as fx
from .matching_sql import OSA
from .queries import _MARKED, _PAIRS, STAGED, _log, import_file
from .registry import cases, cat, listed, query, res, scan

# --- listings ---


@query("SELECT scan_id, user_id, result FROM results WHERE scanned_at >= TIMESTAMP '2024-01-11 00:00:00' AND result = 'chinese' AND inspection_id = 'INSP-2024-8'", res)
def scan_history(spark, sf_dir):
    return insights.scan_history(fx.results(spark, sf_dir), fx.AS_OF, 20, "chinese", "INSP-2024-8").select("scan_id", "user_id", "result")


@query("SELECT scan_id, raw_input FROM results WHERE scanned_at >= TIMESTAMP '2024-01-01 00:00:00' AND user_id = 'u7'", res)
def own_scan_history(spark, sf_dir):
    return insights.scan_history(fx.results(spark, sf_dir), fx.AS_OF, 30, user="u7").select("scan_id", "raw_input")


@query("SELECT component_id, component_name, (SELECT count(*) FROM catalogue WHERE NOT is_deleted AND criticality = 'CRITICAL') AS total FROM catalogue WHERE NOT is_deleted AND criticality = 'CRITICAL' ORDER BY component_name, component_id LIMIT 20 OFFSET 20", cat)
def searched_page(spark, sf_dir):
    """The second page of a search, with the number of rows in all."""
    found = catalogue.search(fx.catalogue(spark, sf_dir), criticality="CRITICAL")
    return catalogue.page_with_total(found, 2, 20).select("component_id", "component_name", "total")


@query("""SELECT component_id FROM catalogue WHERE NOT is_deleted AND category = 'Chip / IC' AND (component_name ILIKE '%motor%' OR part_number ILIKE '%motor%' OR chip_number ILIKE '%motor%' OR manufacturer ILIKE '%motor%' OR remarks ILIKE '%motor%' OR drone_subsystem ILIKE '%motor%' OR supplier ILIKE '%motor%' OR starts_with(search_key, 'MOTOR'))""", cat)
def offline_search(spark, sf_dir):
    """The device's search, whose fields include the subsystem."""
    return catalogue.search(fx.catalogue(spark, sf_dir), "motor", fields=catalogue.SEARCHED_OFFLINE, category="Chip / IC").select("component_id")


@query("SELECT c.component_id, c.component_name FROM catalogue c WHERE NOT is_deleted AND EXISTS (SELECT 1 FROM events e WHERE c.ord = e.event_id % 977)", cat)
def looked_up_components(spark, sf_dir):
    """The live rows behind a batch of ids."""
    wanted = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("CHIP-"), F.lpad((F.col("event_id") % 977).cast("string"), 8, "0")).alias("component_id"))
    return catalogue.named(fx.catalogue(spark, sf_dir), wanted).select("component_id", "component_name")


_INSPECTIONS = """SELECT 'INSP-2024-' || lpad(CAST(o_orderkey AS STRING), 8, '0') AS inspection_number, 'u' || CAST(o_custkey AS STRING) AS inspector_id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'completed' ELSE 'escalated' END AS status, CAST(o_orderdate AS TIMESTAMP) AS started_at FROM {orders}"""
_INSP = _INSPECTIONS.format(orders="orders")


def _inspections(spark, sf_dir):
    return spark.sql(_INSPECTIONS, **fx.tables(spark, sf_dir, "orders"))


@query(f"SELECT inspection_number, status, started_at FROM ({_INSP}) WHERE status = 'open' ORDER BY started_at DESC, inspection_number DESC LIMIT 100")
def open_inspections(spark, sf_dir):
    return insights.listed_inspections(_inspections(spark, sf_dir), "open").select("inspection_number", "status", "started_at")


@query(f"SELECT inspection_number, inspector_id FROM ({_INSP}) WHERE inspector_id = 'u7' ORDER BY started_at DESC, inspection_number DESC LIMIT 100")
def own_inspections(spark, sf_dir):
    return insights.listed_inspections(_inspections(spark, sf_dir), inspector="u7").select("inspection_number", "inspector_id")


@query(f"SELECT (SELECT count(*) FROM ({_INSP}) WHERE inspection_number LIKE 'INSP-2024-%') + 1 AS next_number")
def next_inspection_number(spark, sf_dir):
    return insights.next_number(_inspections(spark, sf_dir), 2024)


@query(f"""SELECT count(*) FILTER (WHERE scanned_at >= TIMESTAMP '2024-01-30 00:00:00') AS scans_today, count(*) FILTER (WHERE scanned_at >= TIMESTAMP '2024-01-24 00:00:00') AS scans_7d, count(*) FILTER (WHERE scanned_at >= TIMESTAMP '2024-01-24 00:00:00' AND result = 'chinese') AS chinese_hits_7d,
  (SELECT count(*) FROM ({_INSP}) WHERE status = 'open') AS open_inspections FROM results""", res)
def dashboard_counters(spark, sf_dir):
    return insights.scan_counters(fx.results(spark, sf_dir), fx.AS_OF, _inspections(spark, sf_dir))


@query("SELECT event_id AS sequence, event_type AS action FROM events WHERE ts >= TIMESTAMP '2024-01-11 00:00:00' AND event_type = 'error' ORDER BY event_id DESC LIMIT 200")
def log_entries(spark, sf_dir):
    return insights.log_entries(_log(spark, sf_dir), fx.AS_OF, 20, "error").select("sequence", "action")


_SESSIONS = "SELECT device_id, arg_max(user_id, struct_pack(a := scanned_at, b := scan_id)) AS user_id FROM results GROUP BY device_id"


@query(f"SELECT r.scan_id, r.device_id, r.user_id FROM results r JOIN ({_SESSIONS}) s ON r.device_id = s.device_id AND r.user_id = s.user_id", res)
def own_queue(spark, sf_dir):
    """Of each device's queue, the scans of the user who used it last."""
    r = fx.results(spark, sf_dir)
    sessions = r.groupBy("device_id").agg(F.max_by("user_id", F.struct("scanned_at", "scan_id")).alias("user_id"))
    return insights.own_queue(r, sessions).select("scan_id", "device_id", "user_id")


@query("SELECT 'batch-' || strftime(ts, '%Y-%m-%d') AS batch_id, count(*) AS rows_total, max(ts) AS committed_at FROM events GROUP BY 1 ORDER BY committed_at DESC, batch_id DESC LIMIT 5")
def latest_batches(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batches = events.groupBy(F.concat(F.lit("batch-"), F.date_format("ts", "yyyy-MM-dd")).alias("batch_id")).agg(F.count(F.lit(1)).alias("rows_total"), F.max("ts").alias("committed_at"))
    return catalogue.latest(batches, "committed_at", "batch_id", 5)


# --- edits ---

_NEW = """SELECT ord AS row_number, CASE WHEN ord % 3 = 0 THEN component_id ELSE 'NEW-' || CAST(ord - ord % 4 AS STRING) END AS component_id, component_name, part_number, chip_number, manufacturer, CASE WHEN ord % 2 = 0 THEN 'China' ELSE country_of_origin END AS country_of_origin, remarks FROM {catalogue}"""


@query(f"""WITH n AS ({_NEW.format(catalogue="catalogue")}), m AS (SELECT *, min(row_number) OVER (PARTITION BY component_id) AS first FROM n)
SELECT m.row_number, m.component_id, CASE WHEN c.component_id IS NOT NULL OR m.row_number > first THEN 'conflict' ELSE 'created' END AS outcome,
  CASE WHEN c.component_id IS NULL AND m.row_number = first THEN CASE WHEN m.country_of_origin IN ('China', 'Hong Kong') THEN 'YES' WHEN m.country_of_origin IN ('', 'Unknown') THEN 'UNKNOWN' ELSE 'NO' END END AS origin
FROM m LEFT JOIN (SELECT component_id FROM catalogue WHERE NOT is_deleted) c ON c.component_id = m.component_id""", cat)
def created_components(spark, sf_dir):
    """A batch of new components: refused where the id is taken, with the post-image of what was made."""
    c = fx.catalogue(spark, sf_dir)
    outcomes = catalogue.create(c, spark.sql(_NEW, catalogue=c))[1]
    return outcomes.select("row_number", "component_id", "outcome", F.col("after.is_chinese").alias("origin"))


_EDITS = """SELECT component_id, CASE WHEN ord % 6 = 0 THEN 'Made in China' WHEN ord % 4 = 0 THEN 'tbd' WHEN ord % 4 = 2 THEN 'France' END AS country_of_origin, CASE WHEN ord % 3 = 0 THEN 'St Micro. Ltd' END AS manufacturer FROM {catalogue} WHERE ord % 2 = 0"""


@query(f"""WITH e AS ({_EDITS.format(catalogue="catalogue")}) SELECT c.component_id, coalesce(CASE WHEN NOT c.is_deleted THEN e.country_of_origin END, c.country_of_origin) AS country_of_origin,
  CASE WHEN c.is_deleted OR e.country_of_origin IS NULL THEN c.is_chinese WHEN e.country_of_origin = 'Made in China' THEN 'YES' WHEN e.country_of_origin = 'tbd' THEN 'UNKNOWN' ELSE 'NO' END AS is_chinese,
  CASE WHEN c.is_deleted OR e.country_of_origin IS NULL THEN c.pending_verification ELSE e.country_of_origin = 'tbd' END AS pending_verification, CASE WHEN NOT c.is_deleted AND e.manufacturer IS NOT NULL THEN 'STMICROELECTRONICS' ELSE c.manufacturer END AS manufacturer
FROM catalogue c LEFT JOIN e ON e.component_id = c.component_id""", cat)
def edited_components(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    return catalogue.edit(c, spark.sql(_EDITS, catalogue=c))[0].select("component_id", "country_of_origin", "is_chinese", "pending_verification", "manufacturer")


@query("SELECT component_id, country_of_origin AS was FROM catalogue WHERE ord % 2 = 0 AND NOT is_deleted", cat)
def edit_pre_images(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    return catalogue.edit(c, spark.sql(_EDITS, catalogue=c))[1].select("component_id", F.col("before.country_of_origin").alias("was"))


@query("SELECT component_id, is_deleted OR is_chinese = 'UNKNOWN' AS is_deleted FROM catalogue", cat)
def soft_deleted(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    return catalogue.soft_delete(c, c.where("is_chinese = 'UNKNOWN'")).select("component_id", "is_deleted")


# --- imports ---


def _versioned(c):
    return c.withColumn("revision", F.lit(1)).drop("ord", "pending_verification")


@query(f"""WITH {STAGED}, fresh AS (SELECT * FROM staged WHERE bucket IN ('new', 'updated'))
SELECT coalesce(c.component_id, f.component_id) AS component_id, coalesce(CASE WHEN bucket IS NOT NULL AND f.name <> '' THEN f.name END, c.component_name) AS component_name, coalesce(CASE WHEN bucket = 'new' THEN f.coo WHEN f.coo <> '' THEN f.coo END, c.country_of_origin) AS country_of_origin,
  coalesce(f.flag, c.is_chinese) AS is_chinese, CASE WHEN bucket IS NOT NULL THEN 100.0 ELSE c.confidence_score END AS confidence_score, CASE WHEN bucket = 'updated' THEN 2 ELSE 1 END AS revision, coalesce(c.is_deleted, false) AS is_deleted FROM catalogue c FULL JOIN fresh f ON f.component_id = c.component_id""", cat)
def committed_import(spark, sf_dir):
    """The catalogue after the staged file is committed."""
    c = fx.catalogue(spark, sf_dir)
    version, _ = imports.commit(_versioned(c), imports.stage(import_file(c), c), "b1")
    return version.select("component_id", "component_name", "country_of_origin", "is_chinese", "confidence_score", "revision", "is_deleted")


@query("SELECT component_id, component_name, country_of_origin, is_chinese, confidence_score, 1 AS revision, is_deleted FROM catalogue", cat)
def rolled_back_import(spark, sf_dir):
    """After commit and rollback everything is as it was."""
    c = fx.catalogue(spark, sf_dir)
    version, revisions = imports.commit(_versioned(c), imports.stage(import_file(c), c), "b1", delete_missing=True)
    return imports.rollback(version, revisions, "b1").select("component_id", "component_name", "country_of_origin", "is_chinese", "confidence_score", "revision", "is_deleted")


@query(f"""WITH {STAGED}, first AS (SELECT component_id, CASE bucket WHEN 'new' THEN 'create' ELSE 'update' END AS operation, 1 AS n FROM staged WHERE bucket IN ('new', 'updated'))
SELECT component_id, operation, CAST(row_number() OVER (PARTITION BY component_id ORDER BY n DESC) AS INT) AS place, 'b' || CAST(n AS VARCHAR) AS batch_id FROM (SELECT * FROM first UNION ALL SELECT component_id, 'update', 2 FROM catalogue WHERE NOT is_deleted)""", cat)
def revision_history(spark, sf_dir):
    """The revisions of each component, newest first: those of the import and those of a later edit of every live row."""
    c = fx.catalogue(spark, sf_dir)
    _, revisions = imports.commit(_versioned(c), imports.stage(import_file(c), c), "b1")
    later = catalogue.edit(_versioned(c).withColumn("pending_verification", F.lit(False)), c.select("component_id", F.lit("x").alias("remarks")))[1]
    every = revisions.select("batch_id", "component_id", "operation", F.lit(1).alias("created_at")).unionByName(later.select(F.lit("b2").alias("batch_id"), "component_id", F.lit("update").alias("operation"), F.lit(2).alias("created_at")))
    return catalogue.history(every).select("component_id", "operation", "place", "batch_id")


@query(f"WITH {STAGED} SELECT component_id FROM catalogue WHERE component_id NOT IN (SELECT component_id FROM staged WHERE bucket IN ('new', 'updated', 'unchanged'))", cat)
def missing_from_file(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    return imports.missing_in_file(imports.stage(import_file(c), c), c)


@query(f"WITH {STAGED} SELECT " + ", ".join(f"count(*) FILTER (WHERE bucket <> 'invalid' AND flag = '{f}') AS {f.lower()}" for f in ("YES", "NO", "UNKNOWN")) + " FROM staged", cat)
def import_origin_counts(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    return imports.origin_counts(imports.stage(import_file(c), c))


@query(f"""WITH {STAGED}, i AS (SELECT row_number, unnest([CASE WHEN name = '' THEN 'component_name' END, CASE WHEN row_number % 13 = 2 THEN 'confidence_score' END, CASE WHEN coo = '' THEN 'country_of_origin' END]) AS field FROM staged)
SELECT row_number, field, CASE field WHEN 'country_of_origin' THEN 'warning' ELSE 'error' END AS severity FROM i WHERE field IS NOT NULL""", cat)
def import_issues(spark, sf_dir):
    """What is wrong with each row of the file."""
    c = fx.catalogue(spark, sf_dir)
    return imports.stage(import_file(c), c).select(F.explode("issues").alias("i")).select("i.row_number", "i.field", "i.severity")


# --- seeds ---

_BRANCH = """SELECT component_id, component_name, CASE WHEN ord % 5 = {k} THEN 'UNKNOWN' ELSE is_chinese END AS is_chinese, '{k}' AS origin_branch, ord AS row_number FROM {catalogue} WHERE ord % 7 >= {k}"""


@query("SELECT component_id, is_chinese, origin_branch FROM (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY CASE WHEN is_chinese = 'UNKNOWN' THEN 1 ELSE 0 END, origin_branch) AS n FROM (" + " UNION ALL ".join(_BRANCH.format(k=k, catalogue="catalogue") for k in range(4)) + ")) WHERE n = 1", cat)
def united_branches(spark, sf_dir):
    """Four seed worksheets as one: the first row of an id whose origin is known, else the first."""
    c = fx.catalogue(spark, sf_dir)
    branches = [spark.sql(_BRANCH.replace("{k}", str(k)), catalogue=c) for k in range(4)]
    return catalogue.union_with_precedence(branches).select("component_id", "is_chinese", "origin_branch")


_BLANK = """SELECT component_id, chip_number, part_number, CASE WHEN ord % 2 = 0 THEN component_name || ' gps' ELSE component_name END AS component_name, CASE WHEN ord % 3 = 0 THEN '' ELSE drone_subsystem END AS drone_subsystem, criticality_policy, CASE WHEN ord % 4 = 0 THEN '' ELSE criticality END AS criticality,
  CASE WHEN ord % 5 = 0 THEN '' ELSE 'own' END AS remarks, '' AS alternative_manufacturer, category, manufacturer, '' AS barcode, '' AS qr_code, 'NO' AS military_grade FROM {catalogue}"""
_SUBSYSTEM = "CASE " + " ".join(f"WHEN contains(upper(component_name), '{n}') THEN '{b}'" for n, b in R.SUBSYSTEM_KEYWORDS) + " ELSE 'Other' END"


def _policy(column: int) -> str:
    return cases("sub", [(p[0], p[column]) for p in R.POLICY])


_ALT = cases("{0}", [(k, "; ".join(v)) for k, v in R.ALTERNATIVES.items()])


@query(f"""WITH b AS ({_BLANK.format(catalogue="catalogue")}), s AS (SELECT *, CASE WHEN drone_subsystem = '' THEN {_SUBSYSTEM} ELSE drone_subsystem END AS sub FROM b)
SELECT component_id, sub AS drone_subsystem, coalesce({_policy(2)}, nullif(criticality_policy, ''), '{R.UNCLASSIFIED_POLICY}') AS criticality_policy, coalesce({_policy(1)}, nullif(criticality, ''), 'REVIEW') AS criticality, CASE WHEN remarks = '' THEN coalesce({_policy(3)}, '') ELSE remarks END AS remarks,
  coalesce({_ALT.format("sub")}, {_ALT.format("category")}, '') AS alternative_manufacturer, 'DCOV:' || component_id || ':' || upper(coalesce(nullif(chip_number, ''), part_number)) AS qr_code,
  CASE WHEN coalesce({_policy(1)}, nullif(criticality, ''), 'REVIEW') = 'CRITICAL' THEN 'YES' ELSE 'NO' END AS military_grade FROM s""", cat)
def enriched_rows(spark, sf_dir):
    rows = spark.sql(_BLANK, catalogue=fx.catalogue(spark, sf_dir))
    return catalogue.enrich(rows).select("component_id", "drone_subsystem", "criticality_policy", "criticality", "remarks", "alternative_manufacturer", "qr_code", "military_grade")


@query(f"""SELECT component_id, CASE WHEN {" OR ".join(f"contains(upper(coo || ' ' || remarks), '{p}')" for p in R.SEED_PHRASES)} THEN 'YES' WHEN trim(coo) = '' THEN 'UNKNOWN'
  WHEN list_has_any(string_split(upper(trim(coo)), '/'), [{listed(R.TERRITORIES)}]) OR {" OR ".join(f"contains(upper(coo), '{p}')" for p in R.SEED_CONTAINS)} THEN 'YES' ELSE 'NO' END AS flag
FROM (SELECT component_id, remarks, CASE ord % 5 WHEN 0 THEN 'Taiwan/CN' WHEN 1 THEN 'Shenzhen area' WHEN 2 THEN 'Unknown' ELSE country_of_origin END AS coo FROM catalogue)""", cat)
def seed_origins(spark, sf_dir):
    """The seed worksheets' older origin rule, which has no list of unknown countries."""
    c = fx.catalogue(spark, sf_dir)
    k = F.col("ord") % 5
    country = F.when(k == 0, "Taiwan/CN").when(k == 1, "Shenzhen area").when(k == 2, "Unknown").otherwise(F.col("country_of_origin"))
    return c.select("component_id", origin.seed_origin(country, F.col("remarks")).alias("flag"))


@query(f"""SELECT component_id, coalesce({cases("k", R.MANUFACTURER_ALIASES.items())}, k) AS maker FROM (SELECT component_id, upper(regexp_replace(regexp_replace(CASE WHEN ord % 3 = 0 THEN 'Mediatek, Inc' WHEN ord % 3 = 1 THEN ' St.  Micro' ELSE manufacturer END, '[.,]', '', 'g'), '\\s+', ' ', 'g')) AS k FROM catalogue)
""".replace("upper(regexp_replace(regexp_replace(CASE", "upper(trim(regexp_replace(regexp_replace(CASE").replace("'\\s+', ' ', 'g')) AS k", "'\\s+', ' ', 'g'))) AS k"), cat)
def seed_maker_keys(spark, sf_dir):
    """The seed worksheets' maker key: legal suffixes stay."""
    c = fx.catalogue(spark, sf_dir)
    name = F.when(F.col("ord") % 3 == 0, "Mediatek, Inc").when(F.col("ord") % 3 == 1, " St.  Micro").otherwise(F.col("manufacturer"))
    return c.select("component_id", X.manufacturer_key(name, suffixes=False).alias("maker"))


@query("""SELECT component_id, is_chinese FROM catalogue WHERE ord % 3 = 0 UNION ALL SELECT component_id, CASE WHEN declared <> '' THEN declared WHEN country_of_origin IN ('China', 'Hong Kong') THEN 'YES' WHEN country_of_origin IN ('', 'Unknown') THEN 'UNKNOWN' ELSE 'NO' END
FROM (SELECT *, CASE WHEN ord % 4 = 0 THEN 'YES' ELSE '' END AS declared FROM catalogue WHERE ord % 3 <> 0)""", cat)
def seeded_catalogue(spark, sf_dir):
    """A third of the parts is there; seeding brings the rest, a declared origin counting."""
    c = fx.catalogue(spark, sf_dir)
    rows = c.withColumn("is_chinese", F.when(F.col("ord") % 4 == 0, "YES").otherwise(""))
    return catalogue.seed(c.where("ord % 3 = 0"), rows).select("component_id", "is_chinese")


@query("SELECT component_id, array_to_string(list_filter(list_transform(string_split(category || '; ' || supplier || ' ;;' || remarks, ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS alternatives FROM catalogue", cat)
def alternatives_lists(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    return c.select("component_id", F.array_join(X.alternatives_list(F.concat("category", F.lit("; "), "supplier", F.lit(" ;;"), "remarks")), "|").alias("alternatives"))


# --- scans ---


@query("SELECT 'scan.flagged' AS action, scan_id, result FROM results WHERE result IN ('chinese', 'unknown_origin')", res)
def flagged_scans(spark, sf_dir):
    return ingest.audited(fx.results(spark, sf_dir)).select("action", "scan_id", "result")


@query("SELECT normalized_input, arg_min(scan_id, struct_pack(a := scanned_at, b := scan_id)) AS scan_id FROM results WHERE result = 'not_found' GROUP BY 1", res)
def first_unknown_notices(spark, sf_dir):
    return ingest.first_unknowns(fx.results(spark, sf_dir)).select("normalized_input", "scan_id")


@query("SELECT normalized_input, count(*) AS hit_count, arg_min(raw_input, struct_pack(a := scanned_at, b := raw_input)) AS raw_input FROM results WHERE result = 'not_found' GROUP BY 1", res)
def appended_queue(spark, sf_dir):
    """The not-found queue as the sum of three batches' rows."""
    r = fx.results(spark, sf_dir)
    hits = [ingest.queue_hits(r.where(F.col("scan_id") % 3 == k)) for k in range(3)]
    return ingest.queue(hits[0].unionByName(hits[1]).unionByName(hits[2])).select("normalized_input", "hit_count", "raw_input")


_LINES = " ".join(f"WHEN starts_with(headline, '{a}') THEN '{b.replace(chr(39), chr(39) * 2)}'" for a, b in R.BANNER_LINES)
_HEADLINE = """CASE scan_id % 7 WHEN 0 THEN 'IDENTITY UNCERTAIN - REQUIRES MANUAL REVIEW' WHEN 1 THEN 'PROBABLE CHINESE COMPONENT - CONFIRM MARKING' WHEN 2 THEN 'OEM NON-CHINESE - COMPONENT ORIGIN NOT DOCUMENTED' WHEN 3 THEN 'CHINESE MANUFACTURER - COMPONENT ORIGIN PRESUMED CHINESE' WHEN 4 THEN 'ORIGIN NOT CONFIRMED' ELSE 'other' END"""


@query(f"""SELECT scan_id, CASE {_LINES} WHEN headline = '{R.WEAK_HEADLINE}' THEN '{R.WEAK_LINE}' ELSE {cases("result", R.RESULT_LINES.items())} END AS line FROM (SELECT scan_id, result, {_HEADLINE} AS headline FROM results)""", res)
def banner_lines(spark, sf_dir):
    r = fx.results(spark, sf_dir).withColumn("headline", F.expr(_HEADLINE))
    return r.select("scan_id", origin.banner_line(F.col("headline"), F.col("result")).alias("line"))


@query(f"""WITH RECURSIVE {_MARKED}, {OSA},
m AS (SELECT p.scan_id, p.a, p.b, distance, CAST(greatest(length(p.a), length(p.b)) AS DOUBLE) AS n, len(list_filter(range(1, least(length(p.a), length(p.b)) + 1), lambda k: substr(p.a, 1, k) = substr(p.b, 1, k))) AS same FROM p LEFT JOIN d ON p.a = d.a AND p.b = d.b)
SELECT scan_id, CASE WHEN a = '' THEN 0.0 WHEN a = b THEN 100.0 ELSE round_even((1.0 - distance / n) * 100 * 0.75 + same / n * 100 * 0.25, 2) END AS similarity FROM m""", scan)
def marking_similarities(spark, sf_dir):
    """Likeness of every marking to its part's key."""
    targets = spark.sql(_PAIRS, **fx.tables(spark, sf_dir, "part", "events")).withColumnRenamed("target", "ord")
    pairs = fx.scans(spark, sf_dir).join(targets, "scan_id").join(fx.catalogue(spark, sf_dir).select("ord", "search_key"), "ord")
    return pairs.select("scan_id", X.similarity(X.normalize(F.col("raw_input")), F.col("search_key")).alias("similarity"))


_IMAGES = """SELECT 'IMG-' || CAST(scan_id AS STRING) AS image_id, scan_id, scan_id % 3 AS kind, raw_input AS best, marking_text AS full_text FROM {scans}"""


@query(f"""WITH i AS ({_IMAGES.format(scans="scans")}) SELECT image_id || CASE WHEN kind = 0 THEN '-' || lpad(CAST(k AS VARCHAR), 3, '0') ELSE '' END AS client_uuid, CASE WHEN kind = 0 THEN best || CAST(k AS VARCHAR) WHEN kind = 1 OR best = '' THEN NULL ELSE best END AS raw_input,
  CASE kind WHEN 1 THEN '{R.SEVERAL_PARTS}' END AS message FROM i JOIN (SELECT unnest([0, 1]) AS k) ON kind = 0 OR k = 0""", scan)
def scans_of_images(spark, sf_dir):
    """Photographs of several packages told apart, of several parts that were not, and of one."""
    images = spark.sql(_IMAGES, scans=fx.scans(spark, sf_dir))
    chip = lambda k: F.struct(F.concat("best", F.lit(str(k))).alias("best"), F.col("full_text"))
    images = images.withColumn("chips", F.when(F.col("kind") == 0, F.array(chip(0), chip(1)))).withColumn("multiple_parts", F.col("kind") == 1)
    return ocr_words.scans_of_images(images).select("client_uuid", "raw_input", "message")


@query("SELECT client_uuid, arg_min(scan_id, struct_pack(a := scanned_at, b := scan_id)) AS scan_id, CAST(1 AS BIGINT) AS stored FROM scans GROUP BY client_uuid", scan)
def uploaded_scans(spark, sf_dir):
    """Devices' queues of JSON files, emptied in batches by the stream and once more in full: each scan is stored once."""
    root = scratch_path(spark, "uploads")
    taken = fx.scans(spark, sf_dir).select("scan_id", "client_uuid", "scanned_at")
    taken.repartition(12, "client_uuid").write.json(f"{root}/queue")
    schema = "scan_id long, client_uuid string, scanned_at timestamp"
    for run in ("first", "again"):
        ingest.ingest(ingest.queued_uploads(spark, f"{root}/queue", schema, 4), f"{root}/store", f"{root}/state-{run}", 16).awaitTermination()
    return spark.read.parquet(f"{root}/store").groupBy("client_uuid").agg(F.min("scan_id").alias("scan_id"), F.count(F.lit(1)).alias("stored"))
