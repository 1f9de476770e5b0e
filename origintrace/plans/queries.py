"""Registry of the library's queries: name -> (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import marking, ocr, origin
from ..functions import text as X
from ..operators import audit, cascade, catalogue, imports, insights, ocr_words, scans
from ..rules import tables as R
from ..session import cut, scratch_path
from ..streaming import ingest
from . import fixtures as fx
from . import matching_sql as M
from .registry import ORACLE_SQL, QUERIES, query
from .registry import cat as _cat
from .registry import listed as _in
from .registry import quote as _quote
from .registry import res as _res
from .registry import scan as _scan
from .registry import words as _words

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
DAYS = 30
_NORM = "regexp_replace(upper(trim(raw_input)), '[^A-Z0-9]', '', 'g')"


# --- text functions ---


@query(f"""SELECT scan_id, norm, translate(norm, '{R.FOLD_FROM}', '{R.FOLD_TO}') AS folded, greatest(length(norm) - 6, 0) AS n_truncations,
  len(list_distinct(list_transform(range(1, greatest(2, length(norm) - 1)), lambda i: substr(norm, i, 3)))) AS n_grams
FROM (SELECT scan_id, {_NORM} AS norm FROM scans)""", _scan)
def marking_keys(spark, sf_dir):
    norm = X.normalize(F.col("raw_input"))
    rows = fx.scans(spark, sf_dir).select("scan_id", norm.alias("norm"))
    return rows.select("scan_id", "norm", X.fold(F.col("norm")).alias("folded"), F.size(X.truncations(F.col("norm"))).alias("n_truncations"), F.size(X.grams(F.col("norm"))).alias("n_grams"))


@query(f"""SELECT component_id, CASE k WHEN {" WHEN ".join(f"{_quote(a)} THEN {_quote(b)}" for a, b in R.MANUFACTURER_ALIASES.items())} ELSE k END AS maker FROM (
SELECT component_id, regexp_replace(trim(regexp_replace(upper(regexp_replace(regexp_replace(trim(manufacturer), '[.,]', '', 'g'), '\\s+', ' ', 'g')), '\\b({"|".join(R.LEGAL_SUFFIXES)})\\b', '', 'g')), '\\s+', ' ', 'g') AS k FROM catalogue)""", _cat)
def maker_keys(spark, sf_dir):
    return fx.catalogue(spark, sf_dir).select("component_id", X.manufacturer_key(F.col("manufacturer")).alias("maker"))


@query("""SELECT component_id, 'CHIP-' || upper(substr(sha1(search_key || '|' || component_id), 1, 8)) AS made_id, 'DCOV:' || component_id || ':' || search_key AS qr FROM catalogue""", _cat)
def made_ids(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    return c.select("component_id", X.hashed_id("CHIP", F.col("search_key"), F.col("component_id")).alias("made_id"), X.qr_payload(F.col("component_id"), F.col("chip_number"), F.col("part_number")).alias("qr"))


@query("""WITH d AS (SELECT component_id, substr('890' || substr(regexp_replace(sha1(component_id), '[^0-9]', '', 'g'), 1, 9) || '000000000000', 1, 12) AS b FROM catalogue)
SELECT component_id, b || CAST((10 - list_sum(list_transform(range(0, 12), lambda i: CAST(substr(b, i + 1, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10 AS VARCHAR) AS barcode FROM d""", _cat)
def synthetic_barcodes(spark, sf_dir):
    return fx.catalogue(spark, sf_dir).select("component_id", X.synthetic_barcode(F.col("component_id")).alias("barcode"))


@query(f"""WITH read_keys AS (SELECT scan_id, {_NORM} AS norm FROM scans), {M.READINGS},
f AS (SELECT scan_id, variant, min(place) AS place FROM readings WHERE variant IS NOT NULL GROUP BY ALL)
SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY place) - 1 AS INT) AS place, variant FROM f QUALIFY place < {R.MOST_VARIANTS}""", _scan)
def glyph_readings(spark, sf_dir):
    """Re-readings of every marking, in their order."""
    return fx.scans(spark, sf_dir).select("scan_id", F.posexplode(X.glyph_variants(X.normalize(F.col("raw_input")))).alias("place", "variant"))


@query(f"WITH {M.LABELS} SELECT scan_id, mpn, label_coo FROM labels_read WHERE mpn <> ''", _scan)
def label_payloads(spark, sf_dir):
    label = X.label_fields(F.col("raw_input"))
    return fx.scans(spark, sf_dir).select("scan_id", F.try_element_at(label, F.lit("mpn")).alias("mpn"), F.try_element_at(label, F.lit("label_coo")).alias("label_coo")).where("mpn IS NOT NULL")


_PAIRS = """SELECT v.event_id AS scan_id, (v.event_id * 31 + v.user_id) % z.n + z.lo AS target FROM {events} v CROSS JOIN (SELECT count(*) AS n, min(p_partkey) AS lo FROM {part}) z"""
_MARKED = """p AS (SELECT s.scan_id, regexp_replace(upper(s.raw_input), '[^A-Z0-9]', '', 'g') AS a, c.search_key AS b FROM scans s JOIN (""" + _PAIRS.format(events="events", part="part") + """) t ON t.scan_id = s.scan_id JOIN catalogue c ON c.ord = t.target),
w AS (SELECT DISTINCT a, b FROM p)"""
_OSA = f"WITH RECURSIVE {_MARKED}, {M.OSA} SELECT p.scan_id, CASE WHEN p.a = '' THEN length(p.b) ELSE distance END AS distance FROM p LEFT JOIN d ON p.a = d.a AND p.b = d.b"


@query(_OSA, _scan)
def marking_distances(spark, sf_dir):
    """Distance of every marking to its part's key, near or far."""
    t = fx.tables(spark, sf_dir, "part", "events")
    targets = spark.sql(_PAIRS, **t).withColumnRenamed("target", "ord")
    pairs = fx.scans(spark, sf_dir).join(targets, "scan_id").join(fx.catalogue(spark, sf_dir).select("ord", "search_key"), "ord")
    return pairs.select("scan_id", X.osa_distance(X.normalize(F.col("raw_input")), F.col("search_key")).alias("distance"))


# Each key against itself with two neighbours swapped (one step for this distance, two edits for plain Levenshtein), with a third
# character put between the swapped ones (three steps, where a distance that edits inside a swap says two), and reversed.
_SWAPS = """SELECT ord, search_key AS a, substr(search_key, 1, 1) || substr(search_key, 3, 1) || substr(search_key, 2, 1) || substr(search_key, 4, 40) AS swapped, substr(search_key, 1, 1) || substr(search_key, 3, 1) || '_' || substr(search_key, 2, 1) || substr(search_key, 4, 40) AS parted FROM {catalogue}"""


@query("SELECT ord, CASE WHEN swapped = a THEN 0 ELSE 1 END AS swapped, CASE WHEN swapped = a THEN 1 ELSE 3 END AS parted FROM (" + _SWAPS.format(catalogue="catalogue") + ")", _cat)
def swap_distances(spark, sf_dir):
    """Swapped neighbours are one step, and no substring is edited twice."""
    rows = spark.sql(_SWAPS, catalogue=fx.catalogue(spark, sf_dir))
    return rows.select("ord", X.osa_distance(F.col("a"), F.col("swapped")).alias("swapped"), X.osa_distance(F.col("a"), F.col("parted")).alias("parted"))


@query(f"""SELECT component_id, CASE WHEN {" OR ".join(f"contains(upper(country_of_origin || ' ' || remarks), {_quote(p)})" for p in R.RESTRICTED_PHRASES)} THEN 'YES'
  WHEN trim(country_of_origin) = '' OR upper(trim(country_of_origin)) IN ({_in(R.UNKNOWN_AT_IMPORT)}) THEN 'UNKNOWN'
  WHEN {" OR ".join(f"contains(upper(country_of_origin), {_quote(p)})" for p in R.RESTRICTED_COUNTRIES)} THEN 'YES' ELSE 'NO' END AS flag FROM catalogue""", _cat)
def derived_origins(spark, sf_dir):
    return fx.catalogue(spark, sf_dir).select("component_id", origin.derive_origin(F.col("country_of_origin"), F.col("remarks"), F.lit("")).alias("flag"))


@query(f"""SELECT p_partkey, CASE {" ".join(f"WHEN contains(upper(t), {_quote(n)}) THEN {_quote(b)}" for n, b in R.SUBSYSTEM_KEYWORDS)} ELSE 'Other' END AS subsystem
FROM (SELECT p_partkey, p_name || CASE p_size % 5 WHEN 0 THEN ' gps unit' WHEN 1 THEN ' esc' WHEN 2 THEN ' servo motor' WHEN 3 THEN ' eo camera' ELSE '' END AS t FROM part)""")
def subsystems(spark, sf_dir):
    t = F.concat("p_name", F.when(F.col("p_size") % 5 == 0, " gps unit").when(F.col("p_size") % 5 == 1, " esc").when(F.col("p_size") % 5 == 2, " servo motor").when(F.col("p_size") % 5 == 3, " eo camera").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", X.subsystem_of(t).alias("subsystem"))


# --- verdicts and markings ---

_TIER = f"""CASE WHEN is_chinese NOT IN ('YES', 'NO') OR trim(country_of_origin) = '' OR upper(country_of_origin) = 'UNKNOWN' THEN 'none'
  WHEN category = 'OEM / LRU' OR contains(upper(verification_source), 'OEM LANDSCAPE') THEN 'manufacturer' ELSE 'component' END"""


@query(f"""SELECT component_id, result, CASE result WHEN 'chinese' THEN 'RED' WHEN 'non_chinese' THEN 'GREEN' ELSE 'YELLOW' END AS banner, tier, confidence_score AS confidence, result <> 'non_chinese' AS review_required,
  result = 'chinese' AND criticality = 'CRITICAL' AS escalate FROM (
SELECT *, CASE WHEN is_chinese = 'YES' THEN 'chinese' WHEN is_chinese = 'NO' AND confidence_score >= 60 AND tier = 'component' THEN 'non_chinese' ELSE 'unknown_origin' END AS result FROM (SELECT *, {_TIER} AS tier FROM catalogue))""", _cat)
def catalogue_verdicts(spark, sf_dir):
    """The verdict of an exact match with each catalogue row."""
    c = fx.catalogue(spark, sf_dir).select("component_id", F.struct(*cascade.CARRIED).alias("component"))
    v = origin.verdict(F.col("component"), F.lit(100.0), F.lit("normalized"))
    return c.select("component_id", v["result"].alias("result"), v["banner"].alias("banner"), v["origin_evidence"].alias("tier"), v["confidence"].alias("confidence"), v["review_required"].alias("review_required"), v["escalate"].alias("escalate"))


@query("""SELECT component_id, CASE WHEN criticality = 'CRITICAL' THEN 'NOT ACCEPTABLE' || CASE WHEN criticality_policy <> '' THEN ' - ' || criticality_policy ELSE ' in a CRITICAL subsystem' END
  WHEN criticality = 'NON-CRITICAL' THEN 'PERMITTED BY POLICY' || CASE WHEN criticality_policy <> '' THEN ' - ' || criticality_policy ELSE '' END || ' (Chinese origin recorded; non-critical subsystem)'
  ELSE 'REFER TO INSPECTING AUTHORITY - subsystem not classified in the policy matrix' END AS decision FROM catalogue WHERE is_chinese = 'YES'""", _cat)
def policy_decisions(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir).where("is_chinese = 'YES'")
    return c.select("component_id", origin.policy_decision(F.lit("chinese"), F.col("criticality"), F.col("criticality_policy")).alias("decision"))


@query(f"""WITH t AS (SELECT scan_id, marking_text, list_filter(regexp_split_to_array(upper(marking_text), '[^A-Z0-9]+'), lambda x: x IN ({_in(R.COUNTRY_CODES)})) AS codes FROM scans)
SELECT scan_id, coalesce(codes[1], CASE WHEN contains(upper(marking_text), 'MADE IN CHINA') OR contains(upper(marking_text), 'PRC') THEN 'CHN' END) AS country_code FROM t""", _scan)
def marked_countries(spark, sf_dir):
    return fx.scans(spark, sf_dir).select("scan_id", marking.country_code(F.col("marking_text"), F.lit("")).alias("country_code"))


@query(f"""WITH to_mark AS (SELECT scan_id, marking_text, true_maker AS maker, raw_input AS part_key, CASE scan_id % 3 WHEN 0 THEN 'NO' WHEN 1 THEN 'YES' ELSE '' END AS flag FROM scans), {M.marking_tables("to_mark")}
SELECT scan_id, code AS country_code, worst, array_to_string(codes, ',') AS codes FROM marked""", _scan)
def marking_findings(spark, sf_dir):
    """Every scan's package marking against its maker, what was read as part (its tokens are no evidence) and an origin."""
    s = fx.scans(spark, sf_dir)
    flag = F.when(F.col("scan_id") % 3 == 0, "NO").when(F.col("scan_id") % 3 == 1, "YES").otherwise("")
    a = marking.marked(s, F.col("marking_text"), F.col("true_maker"), F.col("raw_input"), flag)
    return a.select("scan_id", "country_code", "worst", F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"))


# --- the cascade ---

_LOOK = """WITH live AS (SELECT *, translate(search_key, 'OQILSBZGT', '001158267') AS fold FROM catalogue WHERE NOT is_deleted),
rk AS (SELECT search_key AS probe, count(DISTINCT is_chinese) FILTER (WHERE is_chinese <> 'UNKNOWN') <= 1 AS agreed, arg_max(component_id, struct_pack(a := is_chinese <> 'UNKNOWN', b := confidence_score, c := -ord)) AS best FROM live GROUP BY search_key)"""


@query(_LOOK + """, n AS (SELECT scan_id, regexp_replace(upper(raw_input), '[^A-Z0-9]', '', 'g') AS norm FROM scans)
SELECT n.scan_id, CASE WHEN agreed THEN 'normalized' ELSE 'conflict' END AS method, CASE WHEN agreed THEN best END AS component_id FROM n JOIN rk ON rk.probe = n.norm""", _scan)
def exact_key_matches(spark, sf_dir):
    """Scans whose normalised marking is a key, with what its rows agree on."""
    keys = cascade.resolved_keys(catalogue.live(fx.catalogue(spark, sf_dir)), "search_key")
    s = fx.scans(spark, sf_dir).select("scan_id", X.normalize(F.col("raw_input")).alias("probe"))
    return s.join(keys, "probe").select("scan_id", F.when(F.col("agreed"), "normalized").otherwise("conflict").alias("method"), F.col("component.component_id").alias("component_id"))


@query("""WITH live AS (SELECT * FROM catalogue WHERE NOT is_deleted), k AS (SELECT DISTINCT search_key FROM live), n AS (SELECT scan_id, regexp_replace(upper(raw_input), '[^A-Z0-9]', '', 'g') AS norm FROM scans),
h AS (SELECT norm, search_key, length(search_key) AS n FROM (SELECT DISTINCT norm FROM n) JOIN k ON length(norm) >= 5 AND (starts_with(search_key, norm) OR starts_with(norm, search_key))),
t AS (SELECT *, max(n) OVER (PARTITION BY norm) AS longest FROM h),
f AS (SELECT norm, CASE WHEN count(DISTINCT search_key) > 1 THEN 'ambiguous_prefix' ELSE 'prefix' END AS kind FROM t WHERE n = longest GROUP BY norm)
SELECT scan_id, kind FROM n JOIN f USING (norm)""", _scan)
def prefix_matches(spark, sf_dir):
    """Every scan against the stored keys, whole, partly and wrongly read ones alike: whether one longest stored key or several fit."""
    s = fx.scans(spark, sf_dir).select("scan_id", X.normalize(F.col("raw_input")).alias("norm"))
    looked_up = cut(cascade.lookups(catalogue.live(fx.catalogue(spark, sf_dir))).where("kind = 'K'").select("kind", "probe", "n_rows"), "prefix-keys")
    found = cascade.prefixed_keys(s.select("norm").distinct(), looked_up)
    return s.join(found, "norm").select("scan_id", F.when(F.col("keys") > 1, "ambiguous_prefix").otherwise("prefix").alias("kind"))


@query("""WITH live AS (SELECT *, min(ord) OVER (PARTITION BY search_key) AS begins FROM catalogue WHERE NOT is_deleted), n AS (SELECT DISTINCT substr(regexp_replace(upper(raw_input), '[^A-Z0-9]', '', 'g'), 1, 5) AS norm FROM scans),
h AS (SELECT norm, component_id, search_key, begins, ord, max(length(search_key)) OVER (PARTITION BY norm) AS longest FROM n JOIN live ON length(norm) >= 5 AND (starts_with(search_key, norm) OR starts_with(norm, search_key))),
t AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY begins, ord) AS nth, min(search_key) OVER (PARTITION BY norm) <> max(search_key) OVER (PARTITION BY norm) AS several FROM h WHERE length(search_key) = longest)
SELECT s.scan_id, l.ids FROM (SELECT scan_id, substr(regexp_replace(upper(raw_input), '[^A-Z0-9]', '', 'g'), 1, 5) AS norm FROM scans) s JOIN (SELECT norm, string_agg(component_id, ',' ORDER BY nth) AS ids FROM t WHERE several AND nth <= 10 GROUP BY norm) l USING (norm)""", _scan)
def prefix_suggestions(spark, sf_dir):
    """The first ten parts of each marking that is read to five characters, where several stored keys begin with them."""
    s = fx.scans(spark, sf_dir).select("scan_id", F.substring(X.normalize(F.col("raw_input")), 1, 5).alias("norm"))
    live = cut(catalogue.live(fx.catalogue(spark, sf_dir)), "prefix-catalogue")
    found = cascade.prefix_layer(s, cut(cascade.lookups(live), "prefix-lookups"), live)
    return found.where("method = 'ambiguous_prefix'").select("scan_id", F.array_join(F.transform("suggestions", lambda x: x["component_id"]), ",").alias("ids"))


@query(f"WITH RECURSIVE {M.CASCADE} SELECT scan_id, method, score, component_id, normalized_input, notes FROM matches", _scan)
def cascade_matches(spark, sf_dir):
    """Every scan through the whole cascade, with the key it was found by and what the match notes."""
    m = cascade.match(fx.scans(spark, sf_dir), fx.catalogue(spark, sf_dir))
    return m.select("scan_id", "method", "score", F.col("component.component_id").alias("component_id"), "normalized_input", F.array_join("notes", " | ").alias("notes"))


@query(f"WITH RECURSIVE {M.TRAIL}", _scan)
def match_trail(spark, sf_dir):
    """Every match's other rows: all of a conflict, those that an agreed key has besides, and scored suggestions."""
    c = cut(fx.catalogue(spark, sf_dir), "trail-catalogue")
    return cascade.trail(cut(cascade.match(fx.scans(spark, sf_dir), c), "trail-matches"), c)


@query(M.DISAGREEMENTS, _scan)
def catalogue_disagreements(spark, sf_dir):
    """Scans whose banner differs between the catalogue and a later version of it, in which origins, keys and rows have changed."""
    c = cut(fx.catalogue(spark, sf_dir), "catalogue")
    ord_ = F.col("ord")
    later = c.withColumns({
        "is_chinese": F.when(ord_ % 31 == 3, "YES").when(ord_ % 37 == 5, "UNKNOWN").otherwise(F.col("is_chinese")), "is_deleted": F.col("is_deleted") | (ord_ % 41 == 7),
        "search_key": F.when(ord_ % 53 == 9, F.concat("search_key", F.lit("X"))).otherwise(F.col("search_key")),
    })
    return scans.disagreements(fx.scans(spark, sf_dir), c, later)


@query(f"WITH RECURSIVE {M.VERDICTS}", _scan)
def scan_verdicts(spark, sf_dir):
    """Every scan's verdict after the check of its package marking."""
    r = scans.scan_results(fx.scans(spark, sf_dir), fx.catalogue(spark, sf_dir))
    return r.select("scan_id", "match_method", "match_score", "matched_component_id", "result", "banner", "headline", "confidence", "origin_evidence", "review_required", "policy_decision", "escalate", "worst")


# --- catalogue ---


@query("""SELECT count(*) AS total_components, count(*) FILTER (WHERE is_chinese = 'YES') AS chinese_components, count(*) FILTER (WHERE is_chinese = 'NO') AS non_chinese_components, count(*) FILTER (WHERE is_chinese = 'UNKNOWN') AS unknown_origin,
  count(*) FILTER (WHERE pending_verification) AS pending_verification, count(*) FILTER (WHERE is_chinese = 'YES' AND criticality = 'CRITICAL') AS critical_chinese FROM catalogue WHERE NOT is_deleted""", _cat)
def catalogue_counters(spark, sf_dir):
    return catalogue.counters(fx.catalogue(spark, sf_dir))


@query("""SELECT facet, CASE WHEN value = '' THEN '(blank)' ELSE value END AS value, count(*) AS n FROM (""" + " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value FROM catalogue WHERE NOT is_deleted" for c in catalogue.FACETS) + ") GROUP BY ALL", _cat)
def catalogue_facets(spark, sf_dir):
    return catalogue.facets(fx.catalogue(spark, sf_dir))


@query("""SELECT component_id, component_name FROM catalogue WHERE NOT is_deleted AND criticality = 'CRITICAL' AND (component_name ILIKE '%wid%' OR part_number ILIKE '%wid%' OR chip_number ILIKE '%wid%' OR manufacturer ILIKE '%wid%' OR remarks ILIKE '%wid%' OR barcode ILIKE '%wid%' OR supplier ILIKE '%wid%' OR starts_with(search_key, 'WID'))""", _cat)
def catalogue_search(spark, sf_dir):
    return catalogue.search(fx.catalogue(spark, sf_dir), "wid", criticality="CRITICAL").select("component_id", "component_name")


@query("""WITH q AS (SELECT DISTINCT unnest([split_part(component_name, ' ', 1), substr(supplier, 5, 9), substr(part_number, 3, 4), upper(substr(component_name, 2, 2)), substr(barcode, 6, 5), left(part_number, 2) || '%' || right(part_number, 3)]) AS query FROM catalogue WHERE ord % 7 = 0)
SELECT query, component_id FROM q JOIN catalogue ON NOT is_deleted AND (""" + " OR ".join(f"{c} ILIKE '%' || query || '%'" for c in catalogue.SEARCHED) + """ OR starts_with(search_key, regexp_replace(upper(query), '[^A-Z0-9]', '', 'g'))) WHERE trim(query) <> ''""", _cat)
def indexed_search(spark, sf_dir):
    """Many searches at once through postings of grams: words, parts of numbers, two letters, and a wildcard."""
    c = cut(fx.catalogue(spark, sf_dir), "search-catalogue")
    wild = F.concat(F.substring("part_number", 1, 2), F.lit("%"), F.expr("right(part_number, 3)"))
    asked = F.array(F.split_part(F.col("component_name"), F.lit(" "), F.lit(1)), F.substring("supplier", 5, 9), F.substring("part_number", 3, 4), F.upper(F.substring("component_name", 2, 2)), F.substring("barcode", 6, 5), wild)
    index = scratch_path(spark, "search-index")
    catalogue.write_search_index(c, index)
    return catalogue.search_many(c, index, c.where("ord % 7 = 0").select(F.explode(asked).alias("query")))


@query("SELECT component_id, component_name FROM catalogue WHERE NOT is_deleted ORDER BY component_name, component_id LIMIT 50 OFFSET 50", _cat)
def catalogue_page(spark, sf_dir):
    return catalogue.page(catalogue.live(fx.catalogue(spark, sf_dir)), 2).select("component_id", "component_name")


@query("SELECT drone_subsystem, count(*) AS n FROM catalogue WHERE NOT is_deleted AND is_chinese = 'YES' GROUP BY drone_subsystem", _cat)
def restricted_by_subsystem(spark, sf_dir):
    return catalogue.by_subsystem(fx.catalogue(spark, sf_dir))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE is_chinese = 'YES') AS yes, count(*) FILTER (WHERE is_chinese = 'NO') AS no, count(*) FILTER (WHERE is_chinese = 'UNKNOWN') AS unknown, count(*) FILTER (WHERE criticality = 'CRITICAL') AS critical, count(*) FILTER (WHERE criticality = 'CRITICAL' AND is_chinese = 'YES') AS critical_yes FROM catalogue""", _cat)
def seed_totals(spark, sf_dir):
    return catalogue.seed_summary(fx.catalogue(spark, sf_dir))


@query("SELECT DISTINCT country_of_origin AS value FROM catalogue WHERE NOT is_deleted AND country_of_origin <> ''", _cat)
def distinct_countries(spark, sf_dir):
    return catalogue.distinct_values(fx.catalogue(spark, sf_dir), "country_of_origin")


@query("""SELECT component_id, CASE WHEN is_chinese = 'UNKNOWN' THEN 'store' ELSE category END AS category FROM catalogue""", _cat)
def bulk_updated(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    return catalogue.bulk_update(c, c.where("is_chinese = 'UNKNOWN'"), category="store").select("component_id", "category")


@query("""SELECT component_id, is_chinese, pending_verification FROM (SELECT component_id, CASE WHEN f = 'NO' AND upper(country_of_origin) = 'UNKNOWN' THEN 'UNKNOWN' ELSE f END AS is_chinese, (f = 'NO' AND upper(country_of_origin) = 'UNKNOWN') OR pending_verification AS pending_verification
  FROM (SELECT *, CASE WHEN is_chinese = 'UNKNOWN' THEN 'NO' ELSE is_chinese END AS f FROM catalogue))""", _cat)
def reclassified(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir).withColumn("is_chinese", F.when(F.col("is_chinese") == "UNKNOWN", "NO").otherwise(F.col("is_chinese")))
    return catalogue.reclassify_unknown(c).select("component_id", "is_chinese", "pending_verification")


@query("""SELECT coalesce(a.component_id, b.component_id) AS component_id, CASE WHEN b.remarks <> '' THEN b.remarks ELSE coalesce(a.remarks, b.remarks) END AS remarks, coalesce(a.supplier, b.supplier) AS supplier
  FROM (SELECT * FROM catalogue WHERE ord % 3 <> 0) a FULL JOIN (SELECT component_id, CASE WHEN ord % 2 = 0 THEN '' ELSE 'new' END AS remarks, 'x' AS supplier FROM catalogue WHERE ord % 3 <> 1) b ON a.component_id = b.component_id""", _cat)
def merged_catalogues(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    old = c.where("ord % 3 <> 0").select("component_id", "remarks", "supplier")
    new = c.where("ord % 3 <> 1").select("component_id", F.when(F.col("ord") % 2 == 0, "").otherwise("new").alias("remarks"), F.lit("x").alias("supplier"))
    return catalogue.merge_catalogues(old, new, keep=("supplier",))


@query("""SELECT component_id, CASE WHEN is_deleted THEN 'delete' ELSE 'upsert' END AS op FROM catalogue WHERE ord > 100""", _cat)
def change_feed(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir).withColumn("updated_at", F.col("ord"))
    return catalogue.changed_since(c, F.lit(100)).select("component_id", "op")


# --- imports ---

_FILE = """SELECT CAST(ord + 2 AS INT) AS row_number, CASE WHEN ord % 9 = 0 THEN '' ELSE component_name END AS "Component Name", part_number AS "Part No", CASE WHEN ord % 4 = 0 THEN 'China' ELSE country_of_origin END AS "COO",
  CASE WHEN ord % 13 = 0 THEN '150' ELSE '' END AS "Confidence", CASE WHEN ord % 5 = 0 THEN component_id ELSE 'NEW-' || CAST(ord - ord % 10 AS STRING) END AS "Component ID" FROM {catalogue}"""


def import_file(c: DataFrame) -> DataFrame:
    """A file of all the catalogue's parts: some known ids, each made-up one several times, some rows that don't pass."""
    return c.sparkSession.sql(_FILE.replace('"', "`"), catalogue=c)


STAGED = """f AS (""" + _FILE.format(catalogue="catalogue") + """), v AS (SELECT *, "Component Name" = '' OR "Confidence" <> '' AS invalid FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY "Component ID", invalid ORDER BY row_number) AS rn, CASE WHEN "COO" IN ('China', 'Hong Kong') THEN 'YES' WHEN "COO" IN ('', 'Unknown') THEN 'UNKNOWN' ELSE 'NO' END AS flag FROM v),
staged AS (SELECT d.row_number, d."Component ID" AS component_id, d."Component Name" AS name, d."COO" AS coo, d.flag, c.is_chinese AS old_flag, CAST("Component Name" = '' AS INT) + CAST("Confidence" <> '' AS INT) AS errors, CASE WHEN invalid THEN 'invalid' WHEN rn > 1 THEN 'duplicate' WHEN c.component_id IS NULL THEN 'new'
  WHEN c.component_name <> "Component Name" OR ("COO" <> '' AND c.country_of_origin <> "COO") OR c.is_chinese <> flag OR c.confidence_score <> 100 THEN 'updated' ELSE 'unchanged' END AS bucket
FROM d LEFT JOIN catalogue c ON c.component_id = d."Component ID")"""


@query(f"WITH {STAGED} SELECT row_number, component_id, bucket FROM staged", _cat)
def staged_import(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    return imports.stage(import_file(c), c).select("row_number", "component_id", "bucket")


@query(f"""WITH {STAGED} SELECT count(*) FILTER (WHERE bucket <> 'invalid') AS rows_total, count(*) FILTER (WHERE bucket = 'new') AS rows_new, count(*) FILTER (WHERE bucket = 'updated') AS rows_updated, count(*) FILTER (WHERE bucket = 'unchanged') AS rows_unchanged,
  count(*) FILTER (WHERE bucket = 'duplicate') AS rows_duplicate, CAST(sum(errors) AS BIGINT) AS rows_invalid, count(*) FILTER (WHERE bucket = 'updated' AND flag <> old_flag) AS origin_flips FROM staged""", _cat)
def import_summary(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    return imports.summary(imports.stage(import_file(c), c))


# --- scans, dashboards, reports ---


@query("""SELECT count(*) FILTER (WHERE scanned_at >= TIMESTAMP '2024-01-30 00:00:00') AS scans_today, count(*) FILTER (WHERE scanned_at >= TIMESTAMP '2024-01-24 00:00:00') AS scans_7d, count(*) FILTER (WHERE scanned_at >= TIMESTAMP '2024-01-24 00:00:00' AND result = 'chinese') AS chinese_hits_7d FROM results""", _res)
def scan_counters(spark, sf_dir):
    return insights.scan_counters(fx.results(spark, sf_dir), fx.AS_OF)


@query("SELECT mix, value, count(*) AS n FROM (SELECT 'result' AS mix, result AS value FROM results UNION ALL SELECT 'input_mode', input_mode FROM results UNION ALL SELECT 'match_method', match_method FROM results) GROUP BY ALL", _res)
def scan_mixes(spark, sf_dir):
    return insights.mixes(fx.results(spark, sf_dir))


@query("SELECT strftime(scanned_at, '%Y-%m-%d') AS day, count(*) AS scans, count(*) FILTER (WHERE result = 'chinese') AS chinese FROM results GROUP BY 1", _res)
def daily_trend(spark, sf_dir):
    return insights.daily_trend(fx.results(spark, sf_dir))


@query("SELECT strftime(scanned_at, '%Y-%m') AS month, " + ", ".join(f"nullif(count(*) FILTER (WHERE result = '{r}'), 0) AS {r}" for r in insights.RESULTS) + " FROM results GROUP BY 1", _res)
def monthly_trend(spark, sf_dir):
    return insights.monthly_trend(fx.results(spark, sf_dir))


@query("SELECT location_label AS location, (dayofweek(scanned_at) + 6) % 7 AS weekday, count(*) AS hits FROM results WHERE result = 'chinese' GROUP BY 1, 2", _res)
def heat_map(spark, sf_dir):
    return insights.heat_map(fx.results(spark, sf_dir))


@query("""SELECT h.component_id, h.hits, c.component_name, c.manufacturer, c.drone_subsystem FROM (SELECT matched_component_id AS component_id, count(*) AS hits FROM results WHERE result = 'chinese' AND matched_component_id IS NOT NULL GROUP BY 1) h LEFT JOIN catalogue c USING (component_id) ORDER BY hits DESC, component_id LIMIT 15""", _res)
def most_detected(spark, sf_dir):
    return insights.most_detected(fx.results(spark, sf_dir), fx.catalogue(spark, sf_dir))


@query("SELECT c.manufacturer, count(*) AS hits FROM results r JOIN catalogue c ON c.component_id = r.matched_component_id WHERE result = 'chinese' GROUP BY 1 ORDER BY hits DESC, manufacturer LIMIT 15", _res)
def top_manufacturers(spark, sf_dir):
    return insights.top_manufacturers(fx.results(spark, sf_dir), fx.catalogue(spark, sf_dir))


@query("SELECT matched_component_id AS component_id, count(*) AS hits FROM results WHERE matched_component_id IS NOT NULL GROUP BY 1 ORDER BY hits DESC, component_id LIMIT 15", _res)
def most_scanned(spark, sf_dir):
    return insights.most_scanned(fx.results(spark, sf_dir))


@query("SELECT scan_id, result FROM results ORDER BY scanned_at DESC, scan_id DESC LIMIT 10", _res)
def recent_scans(spark, sf_dir):
    return insights.recent(fx.results(spark, sf_dir)).select("scan_id", "result")


@query("SELECT scan_id, 'Chinese-origin part in a CRITICAL subsystem' AS message FROM results WHERE result = 'chinese' AND criticality = 'CRITICAL' ORDER BY scanned_at DESC, scan_id DESC LIMIT 10", _res)
def critical_alerts(spark, sf_dir):
    return insights.critical_alerts(fx.results(spark, sf_dir)).select("scan_id", "message")


@query("""SELECT scan_id, strftime(scanned_at, '%Y-%m-%d %H:%M') AS scanned_at, raw_input, normalized_input, coalesce(matched_component_id, '') AS matched_component_id, coalesce(component_name, '') AS component_name, coalesce(manufacturer, '') AS manufacturer, coalesce(country_of_origin, '') AS country_of_origin,
  result, r.criticality, match_method, round_even(match_score, 1) AS match_score, location_label FROM results r LEFT JOIN catalogue c ON c.component_id = r.matched_component_id""", _res)
def inspection_report(spark, sf_dir):
    return insights.inspection_report(fx.results(spark, sf_dir), fx.catalogue(spark, sf_dir))


@query("""SELECT component_id, component_name, chip_number, manufacturer, country_of_origin, drone_subsystem, criticality, verification_source, remarks, row_number() OVER (ORDER BY criticality <> 'CRITICAL', drone_subsystem, component_name, component_id) AS place FROM catalogue WHERE NOT is_deleted AND is_chinese = 'YES'""", _cat)
def restricted_report(spark, sf_dir):
    return insights.origin_report(fx.catalogue(spark, sf_dir), "YES")


@query("""SELECT component_id, component_name, chip_number, manufacturer, country_of_origin, drone_subsystem, criticality, verification_source, remarks, row_number() OVER (ORDER BY criticality <> 'CRITICAL', drone_subsystem, component_name, component_id) AS place FROM catalogue WHERE NOT is_deleted AND is_chinese = 'UNKNOWN'""", _cat)
def unknown_report(spark, sf_dir):
    return insights.origin_report(fx.catalogue(spark, sf_dir), "UNKNOWN")


@query("""SELECT 'Total Components' AS metric, count(*) AS value FROM catalogue WHERE NOT is_deleted UNION ALL SELECT 'Chinese Components', count(*) FILTER (WHERE is_chinese = 'YES') FROM catalogue WHERE NOT is_deleted
UNION ALL SELECT 'Non Chinese Components', count(*) FILTER (WHERE is_chinese = 'NO') FROM catalogue WHERE NOT is_deleted UNION ALL SELECT 'Unknown Origin', count(*) FILTER (WHERE is_chinese = 'UNKNOWN') FROM catalogue WHERE NOT is_deleted
UNION ALL SELECT 'Pending Verification', count(*) FILTER (WHERE pending_verification) FROM catalogue WHERE NOT is_deleted UNION ALL SELECT 'Critical Chinese', count(*) FILTER (WHERE is_chinese = 'YES' AND criticality = 'CRITICAL') FROM catalogue WHERE NOT is_deleted
UNION ALL SELECT 'Scans (30d): ' || result, count(*) FROM results WHERE scanned_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY result UNION ALL SELECT 'Database revision', 1""", _res)
def statistics_report(spark, sf_dir):
    seen = insights.window(fx.results(spark, sf_dir), fx.AS_OF, DAYS)
    return insights.statistics_report(catalogue.counters(fx.catalogue(spark, sf_dir)), seen, DAYS, 1)


@query("""SELECT strftime(scanned_at, '%Y-%m') AS month, count(DISTINCT inspection_id) AS inspections, count(*) AS scans, count(*) FILTER (WHERE result = 'chinese') AS chinese_hits, count(*) FILTER (WHERE result = 'unknown_origin') AS unknown, count(*) FILTER (WHERE result = 'not_found') AS not_found, count(DISTINCT user_id) AS distinct_inspectors FROM results GROUP BY 1""", _res)
def monthly_report(spark, sf_dir):
    return insights.monthly_report(fx.results(spark, sf_dir))


@query("""SELECT device_id || ' ' || strftime(scanned_at, '%Y-%m-%d') AS report, sha256(string_agg('normalized_input=' || normalized_input || '|result=' || result || '|scan_id=' || CAST(scan_id AS VARCHAR), '' ORDER BY scan_id)) AS digest FROM results GROUP BY 1""", _res)
def report_digests(spark, sf_dir):
    """One digest for the report of each device and day."""
    report = F.concat_ws(" ", "device_id", F.date_format("scanned_at", "yyyy-MM-dd"))
    rows = fx.results(spark, sf_dir).select(report.alias("report"), "scan_id", "normalized_input", "result")
    return insights.body_digest(rows, ["scan_id"], "report")


@query("SELECT inspection_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE result = '{r}') AS {r}" for r in insights.RESULTS) + " FROM results WHERE inspection_id IS NOT NULL GROUP BY 1", _res)
def inspection_tally(spark, sf_dir):
    return insights.inspection_tally(fx.results(spark, sf_dir))


@query("""WITH v AS (SELECT 'INSP-2024-' || CAST(o_orderkey % 40 AS VARCHAR) AS inspection_id, max(CASE WHEN o_orderkey % 3 = 0 THEN 'clear' ELSE 'hold' END) AS verdict FROM orders GROUP BY 1),
t AS (SELECT inspection_id, count(*) FILTER (WHERE result = 'chinese') AS bad FROM results GROUP BY 1)
SELECT v.inspection_id, verdict, CASE WHEN coalesce(bad, 0) > 0 AND verdict = 'clear' THEN 'rejected' WHEN coalesce(bad, 0) > 0 THEN 'escalated' ELSE 'completed' END AS status FROM v LEFT JOIN t USING (inspection_id)""", _res)
def signed_off(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    verdicts = orders.groupBy(F.concat(F.lit("INSP-2024-"), (F.col("o_orderkey") % 40).cast("string")).alias("inspection_id")).agg(F.max(F.when(F.col("o_orderkey") % 3 == 0, "clear").otherwise("hold")).alias("verdict"))
    return insights.sign_off(insights.inspection_tally(fx.results(spark, sf_dir)), verdicts)


@query("""SELECT normalized_input, count(*) AS hit_count, arg_min(raw_input, struct_pack(a := scanned_at, b := scan_id)) AS raw_input, arg_min(user_id, struct_pack(a := scanned_at, b := scan_id)) AS reported_by FROM results WHERE result = 'not_found' GROUP BY 1""", _res)
def not_found_queue(spark, sf_dir):
    return scans.not_found_queue(fx.results(spark, sf_dir)).drop("created_at")


@query("""SELECT scan_id, coalesce(epoch_us(scanned_at) - lag(epoch_us(scanned_at)) OVER (PARTITION BY device_id, normalized_input ORDER BY scanned_at, scan_id) <= 600000000, false) AS is_repeat FROM results""", _res)
def repeat_scans(spark, sf_dir):
    return scans.repeat_scans(fx.results(spark, sf_dir)).select("scan_id", "is_repeat")


@query("""SELECT scan_id, CASE WHEN row_number() OVER (PARTITION BY client_uuid ORDER BY scanned_at, scan_id) = 1 THEN 'accepted' ELSE 'duplicate' END AS status FROM results""", _res)
def pushed_scans(spark, sf_dir):
    return scans.first_of_each(fx.results(spark, sf_dir)).select("scan_id", "status")


@query("""SELECT scan_id FROM (SELECT *, row_number() OVER (PARTITION BY client_uuid ORDER BY scanned_at, scan_id) AS n FROM results WHERE scan_id % 3 = 0) WHERE n = 1 AND client_uuid NOT IN (SELECT client_uuid FROM results WHERE scan_id % 5 = 0)""", _res)
def ingested_scans(spark, sf_dir):
    """What a batch adds to a store that already has some of its scans."""
    r = fx.results(spark, sf_dir)
    return ingest.new_scans(r.where("scan_id % 3 = 0"), r.where("scan_id % 5 = 0")).select("scan_id")


# One try after the other: a client's log holds the times of what was let in within the window (2 in 6 hours).
_ADMITTED = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s(user_id, event_id, ts, i, log, admitted) AS (SELECT user_id, event_id, ts, i, [t], true FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.ts, e.i, CASE WHEN len(list_filter(s.log, lambda x: e.t - x <= 21600)) < 2 THEN list_append(list_filter(s.log, lambda x: e.t - x <= 21600), e.t) ELSE s.log END, len(list_filter(s.log, lambda x: e.t - x <= 21600)) < 2
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, event_id, ts, admitted FROM s"""


@query(_ADMITTED)
def rate_limited_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return ingest.rate_limited(e, "user_id", "ts", "event_id", limit=2, window=6 * 3600.0)


# A right password while no lock holds clears the count; the fifth failure and every one after it locks for three days.
_LOCKED = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, epoch(ts) AS t, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s(user_id, event_id, ts, ok, i, failed, until, outcome) AS (SELECT user_id, event_id, ts, ok, i, CASE WHEN ok THEN 0 ELSE 1 END, CAST(0 AS DOUBLE), CASE WHEN ok THEN 'ok' ELSE 'failed' END FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.ts, e.ok, e.i, CASE WHEN e.t < s.until THEN s.failed WHEN e.ok THEN 0 ELSE s.failed + 1 END,
    CASE WHEN e.t < s.until THEN s.until WHEN e.ok THEN 0 WHEN s.failed + 1 >= 5 THEN e.t + 259200 ELSE s.until END, CASE WHEN e.t < s.until THEN 'locked' WHEN e.ok THEN 'ok' ELSE 'failed' END
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, event_id, ts, ok, outcome FROM s"""


@query(_LOCKED)
def locked_out_logins(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("ok"))
    return ingest.lockout(e, "user_id", "ts", "ok", "event_id", minutes=3 * 24 * 60)


@query("""SELECT scan_id, device_id FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY scanned_at DESC, scan_id DESC) AS n FROM results) WHERE n <= 20""", _res)
def retained_history(spark, sf_dir):
    r = fx.results(spark, sf_dir).withColumn("order_key", F.struct("scanned_at", "scan_id"))
    return ingest.retained(r, "device_id", "order_key", R.RETENTION["staged"]).select("scan_id", "device_id")


# --- OCR words ---


_MERGED = """SELECT image_id, word, avg(confidence) + least(count(DISTINCT engine || '|' || variant) - 1, 4) * 6.0 AS vote_score, count(DISTINCT engine || '|' || variant) AS votes FROM (SELECT *, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') AS word FROM words WHERE level = 'word') WHERE length(word) >= 2 GROUP BY 1, 2"""


@query(_MERGED, _words)
def merged_ocr_words(spark, sf_dir):
    return ocr_words.merged_words(fx.words(spark, sf_dir))


@query("""WITH l AS (SELECT image_id, trim(regexp_replace(upper(text), '\\s+', ' ', 'g')) AS line, count(DISTINCT engine || '|' || variant) AS votes FROM words WHERE level = 'line' GROUP BY 1, 2),
c AS (SELECT DISTINCT image_id, unnest(string_split(line, ' ')) AS w FROM l),
s AS (SELECT image_id, trim(upper(text)) AS line, engine, variant FROM words WHERE level = 'word' AND trim(upper(text)) <> '')
SELECT * FROM l UNION ALL SELECT s.image_id, s.line, count(DISTINCT engine || '|' || variant) FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.image_id = s.image_id AND c.w = s.line) GROUP BY 1, 2""", _words)
def physical_marking_lines(spark, sf_dir):
    return ocr_words.physical_lines(fx.words(spark, sf_dir))


def _kind(text: str) -> str:
    """The class of a word, in SQL."""
    u, t = f"upper({text})", f"regexp_replace(upper({text}), '\\s+', '', 'g')"
    return f"""CASE WHEN {t} = '' THEN 'noise' WHEN regexp_matches({u}, '{R.RE_COUNTRY}') THEN 'country_of_origin' WHEN {" OR ".join(f"(starts_with({t}, '{w}') AND length({t}) <= {len(w) + 2})" for w in R.VENDOR_WORDS)} THEN 'vendor' WHEN {t} IN ({_in(R.NOISE_WORDS)}) THEN 'noise'
  WHEN regexp_matches({t}, '{R.RE_DATE}') AND length({t}) = 4 THEN 'date_code' WHEN regexp_matches({t}, '{R.RE_PART}') AND regexp_matches({t}, '[0-9]') AND length({t}) >= 5 THEN 'part_number' WHEN regexp_matches({t}, '{R.RE_LOT}') THEN 'lot_code' ELSE 'other' END"""


def _shape(text: str, kind: str) -> str:
    """A word's score by its class, length and letters, in SQL."""
    t = f"regexp_replace(upper({text}), '[^A-Z0-9]', '', 'g')"
    letters, digits = f"regexp_matches({t}, '[A-Z]')", f"regexp_matches({t}, '[0-9]')"
    base = " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.CLASS_SCORES.items())
    return f"""(CASE {kind} {base} END + CASE WHEN length({t}) BETWEEN 8 AND 16 THEN 12.0 WHEN length({t}) < 6 THEN -20.0 ELSE 0.0 END + CASE WHEN {letters} AND {digits} THEN 8.0 ELSE 0.0 END - CASE WHEN {digits} AND NOT {letters} THEN 15.0 ELSE 0.0 END)"""


@query(f"""WITH m AS ({_MERGED}), k AS (SELECT *, {_kind("word")} AS kind FROM m), s AS (SELECT *, 0.7 * CAST({_shape("word", "kind")} AS DOUBLE) + 0.3 * vote_score AS score FROM k)
SELECT image_id, word, kind, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY image_id ORDER BY round(score, 6) DESC, word) AS INT) AS place FROM s QUALIFY place <= 12""", _words)
def ranked_ocr_candidates(spark, sf_dir):
    return ocr_words.ranked_candidates(fx.words(spark, sf_dir)).select("image_id", "word", "kind", "score", "place")


@query(f"WITH m AS ({_MERGED}), k AS (SELECT image_id, word, {_kind('word')} AS kind FROM m) SELECT image_id, kind, string_agg(word, ',' ORDER BY word) AS words FROM k GROUP BY image_id, kind", _words)
def classed_ocr_words(spark, sf_dir):
    """The words of each image by class."""
    return ocr_words.by_class(fx.words(spark, sf_dir)).withColumn("words", F.array_join("words", ","))


@query(f"""WITH s AS (SELECT image_id, text, ord, CAST({_shape("text", _kind("text"))} AS DOUBLE) AS score FROM words WHERE level = 'word')
SELECT image_id, text, score, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS INT) AS place FROM s QUALIFY place <= 12""", _words)
def offline_ocr_candidates(spark, sf_dir):
    """The device's ranking of words: shape, then reading order."""
    return ocr_words.ranked_offline(fx.words(spark, sf_dir))


@query("SELECT DISTINCT text, " + _kind("text") + " AS kind FROM words", _words)
def classified_words(spark, sf_dir):
    return fx.words(spark, sf_dir).select("text", ocr.classify_marking(F.col("text")).alias("kind")).distinct()


@query(None)
def distinct_ocr_parts(spark, sf_dir):
    return ocr_words.distinct_parts(fx.words(spark, sf_dir))


# --- audit log ---

SECRET = b"a key that the tests use"


def _log(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("sequence"), F.concat(F.lit("u"), "user_id").alias("actor_id"), F.lit("").alias("actor_username"), F.col("event_type").alias("action"), F.lit("event").alias("entity_type"),
        F.col("event_id").cast("string").alias("entity_id"), F.col("props").alias("detail_json"), F.lit("").alias("ip_address"), F.lit("").alias("user_agent"), F.col("ts").cast("timestamp").alias("occurred_at"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("prev_hash"), F.sha2((F.col("event_id") + 1).cast("string"), 256).alias("hash"),
    )


@query(f"""SELECT event_id AS sequence, coalesce(lag(sha256(CAST(event_id + 1 AS VARCHAR))) OVER (ORDER BY event_id), '{R.GENESIS}') AS stored FROM events""")
def chain_predecessors(spark, sf_dir):
    """Each log entry's stored predecessor, linked without a global window."""
    return audit.with_previous(_log(spark, sf_dir)).select("sequence", "stored")


def _chained(spark, sf_dir) -> DataFrame:
    """All events in a log for each user, the later half of them appended to what the first half has left."""
    events = _log(spark, sf_dir).withColumnRenamed("sequence", "event_key").drop("prev_hash", "hash")
    empty = _log(spark, sf_dir).where("false")
    noon = events.agg(F.expr("percentile_approx(occurred_at, 0.5)")).first()[0]
    early = cut(audit.append(empty, events.where(F.col("occurred_at") <= F.lit(noon)), SECRET, by="actor_id"), "log")
    return cut(audit.append(early, events.where(F.col("occurred_at") > F.lit(noon)), SECRET, by="actor_id"), "log")


_NUMBERED = "n AS (SELECT *, 'u' || CAST(user_id AS VARCHAR) AS actor_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)"


@query(f"WITH {_NUMBERED} SELECT actor_id, count(*) AS entries, true AS intact, CAST(NULL AS BIGINT) AS first_broken_sequence FROM n GROUP BY actor_id")
def verified_chain(spark, sf_dir):
    """Every user's log, appended in two batches, is found intact."""
    return audit.verify(_chained(spark, sf_dir), SECRET, "actor_id")


@query(f"WITH {_NUMBERED} SELECT actor_id, count(*) AS entries, count(*) < 3 AS intact, CASE WHEN count(*) >= 3 THEN CAST(3 AS BIGINT) END AS first_broken_sequence FROM n GROUP BY actor_id")
def tampered_chain(spark, sf_dir):
    """The same logs with each one's third entry changed: that is the first broken one."""
    log = _chained(spark, sf_dir)
    return audit.verify(log.withColumn("detail_json", F.when(F.col("sequence") == 3, "{}").otherwise(F.col("detail_json"))), SECRET, "actor_id")


def _hmac_sql(message: str) -> str:
    """HMAC-SHA256 of an ASCII text under SECRET, composed of sha256 and the key's pads."""
    pads = ["".join(rf"\x{b ^ p:02X}" for b in SECRET.ljust(64, b"\0")) for p in (0x36, 0x5C)]
    return f"sha256('{pads[1]}'::BLOB || unhex(sha256('{pads[0]}'::BLOB || encode({message}))))"


_JSON = """'{"action":"' || event_type || '","actor_id":"' || actor_id || '","actor_username":"","detail_json":"' || replace(replace(props, '\\', '\\\\'), '"', '\\"') || '","entity_id":"' || event_id || '","entity_type":"event","ip_address":"","occurred_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00","sequence":' || sequence || ',"user_agent":""}'"""


@query(f"""WITH RECURSIVE {_NUMBERED}, j AS (SELECT actor_id, event_type, event_id, sequence, {_JSON} AS canonical FROM n),
c(actor_id, sequence, prev_hash, hash) AS (SELECT actor_id, sequence, '{R.GENESIS}', {_hmac_sql(f"'{R.GENESIS}' || canonical")} FROM j WHERE sequence = 1
  UNION ALL SELECT j.actor_id, j.sequence, c.hash, {_hmac_sql("c.hash || j.canonical")} FROM c JOIN j ON j.actor_id = c.actor_id AND j.sequence = c.sequence + 1)
SELECT actor_id, sequence, event_type AS action, CAST(event_id AS VARCHAR) AS entity_id, prev_hash, hash FROM c JOIN j USING (actor_id, sequence)""")
def appended_log(spark, sf_dir):
    """Every user's log as it is numbered and chained on, with its digests."""
    return _chained(spark, sf_dir).select("actor_id", "sequence", "action", "entity_id", "prev_hash", "hash")


# The same queries under the names they had while these were the slices of them that SQL could follow.
for _whole, _name in (("whole_prefix_matches", "prefix_matches"), ("whole_marking_distances", "marking_distances"), ("whole_staged_import", "staged_import")):
    QUERIES[_whole], ORACLE_SQL[_whole] = QUERIES[_name], ORACLE_SQL[_name]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of every scan through the whole cascade, counted by method and banner."""
    r = scans.scan_results(fx.scans(spark, sf_dir), fx.catalogue(spark, sf_dir))
    return r.groupBy("match_method", "banner").agg(F.count(F.lit(1)).alias("scans"))
