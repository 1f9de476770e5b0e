"""Domain tables derived from the driver's tables, by one SQL text that Spark and other engines both read.

There are no part markings in those tables, so catalogue, scans and the rest follow from their keys by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

CATALOGUE = """
SELECT p.p_partkey AS ord,
  'CHIP-' || lpad(CAST(p.p_partkey AS STRING), 8, '0') AS component_id,
  p.p_name || ' ' || p.p_brand AS component_name,
  m.marking AS part_number,
  CASE WHEN p.p_partkey % 3 = 0 THEN '' ELSE m.marking END AS chip_number,
  CASE WHEN p.p_partkey % 5 = 0 THEN 'ST Microelectronics Inc.' ELSE s.s_name END AS manufacturer,
  CASE WHEN n.n_nationkey IN (0, 1) THEN 'China' WHEN n.n_nationkey = 2 THEN 'Unknown' WHEN n.n_nationkey = 3 THEN '' WHEN n.n_nationkey = 4 THEN 'Hong Kong' ELSE n.n_name END AS country_of_origin,
  CASE WHEN n.n_nationkey IN (0, 1, 4) THEN 'YES' WHEN n.n_nationkey IN (2, 3) THEN 'UNKNOWN' ELSE 'NO' END AS is_chinese,
  CASE WHEN p.p_type = 'PROMO' THEN 'OEM / LRU' ELSE 'Chip / IC' END AS category,
  CASE p.p_size % 4 WHEN 0 THEN 'GNSS Receiver' WHEN 1 THEN 'ESC' WHEN 2 THEN 'Motor' ELSE 'Radio Modem' END AS drone_subsystem,
  CASE p.p_size % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'NON-CRITICAL' ELSE 'REVIEW' END AS criticality,
  CASE p.p_size % 3 WHEN 0 THEN 'Chinese origin NOT acceptable' WHEN 1 THEN 'Permitted' ELSE '' END AS criticality_policy,
  '890' || lpad(CAST(p.p_partkey AS STRING), 10, '0') AS barcode,
  'DCOV:CHIP-' || lpad(CAST(p.p_partkey AS STRING), 8, '0') AS qr_code,
  CASE WHEN p.p_partkey % 7 = 0 THEN 'batch note ' || p.p_type ELSE '' END AS remarks,
  s.s_name AS supplier,
  CAST(100 - p.p_size AS DOUBLE) AS confidence_score,
  'Technical Inspection Team' AS verified_by,
  CASE WHEN p.p_partkey % 11 = 0 THEN 'OEM landscape' ELSE 'Physical teardown' END AS verification_source,
  m.marking AS search_key,
  n.n_nationkey IN (2, 3) AS pending_verification,
  p.p_partkey % 50 = 49 AS is_deleted
FROM {part} p
JOIN (SELECT p_partkey, 'STX' || lpad(CAST(((p_partkey - CASE WHEN p_partkey % 10 = 1 THEN 1 ELSE 0 END) * 7919) % 1000000 AS STRING), 6, '0')
    || CASE (p_partkey - CASE WHEN p_partkey % 10 = 1 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'C8T6' WHEN 1 THEN 'KCU6' WHEN 2 THEN 'BCPZ' ELSE 'QFN1' END AS marking FROM {part}) m ON m.p_partkey = p.p_partkey
JOIN (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey
JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
JOIN {nation} n ON n.n_nationkey = (s.s_nationkey + p.p_partkey) % 25
"""

SCANS = """
SELECT e.event_id AS scan_id, 'u' || CAST(e.user_id AS STRING) AS user_id, CAST(e.ts AS TIMESTAMP) AS scanned_at, e.event_type,
  CASE e.event_type WHEN 'view' THEN 'barcode' WHEN 'click' THEN 'ocr' WHEN 'signup' THEN 'qr' ELSE 'manual' END AS input_mode,
  'DEV-' || CAST(e.user_id % 17 AS STRING) AS device_id,
  'site ' || CAST(e.event_id % 9 AS STRING) AS location_label,
  CASE WHEN e.event_id % 4 = 0 THEN 'INSP-2024-' || CAST(e.event_id % 40 AS STRING) END AS inspection_id,
  'req-' || CAST(e.event_id - e.event_id % 13 % 2 AS STRING) AS client_uuid,
  c.manufacturer AS true_maker,
  CASE e.event_id % 10
    WHEN 0 THEN c.part_number
    WHEN 1 THEN lower(substr(c.part_number, 1, 3)) || ' ' || lower(substr(c.part_number, 4, 4)) || '-' || lower(substr(c.part_number, 8, 20))
    WHEN 2 THEN c.part_number || ' GQ' || CAST(e.event_id % 90 + 10 AS STRING) || 'J'
    WHEN 3 THEN '5TX' || substr(c.part_number, 4, 20)
    WHEN 4 THEN '57X' || substr(c.part_number, 4, 20)
    WHEN 5 THEN substr(c.part_number, 1, 8)
    WHEN 6 THEN substr(c.part_number, 1, 5) || substr(c.part_number, 7, 20)
    WHEN 7 THEN 'ZZ' || CAST(e.event_id * 13 AS STRING) || 'W'
    WHEN 8 THEN '[)>' || chr(30) || '06' || chr(29) || '1P' || c.part_number || chr(29) || '4LCHN' || chr(30) || chr(4)
    ELSE c.barcode END AS raw_input,
  CASE e.event_id % 6
    WHEN 0 THEN c.part_number || chr(10) || 'GK 21U 9R' || chr(10) || 'CHN 2219'
    WHEN 1 THEN c.part_number || '|Y5 2219|PHL'
    WHEN 2 THEN c.part_number || chr(10) || 'made in china'
    WHEN 3 THEN c.part_number || chr(10) || 'GK 99' || chr(10) || '2219'
    ELSE '' END AS marking_text
FROM (SELECT v.*, (v.event_id * 31 + v.user_id) % z.n + z.lo AS target FROM {events} v CROSS JOIN (SELECT count(*) AS n, min(p_partkey) AS lo FROM {part}) z) e
JOIN {catalogue} c ON c.ord = e.target
"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CATALOGUE, **tables(spark, sf_dir, "part", "lineitem", "supplier", "nation"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCANS, catalogue=catalogue(spark, sf_dir), **tables(spark, sf_dir, "part", "events"))


def _after(tables: str, sql: str) -> str:
    """The SQL with common tables put before its own."""
    sql = sql.strip()
    for word in ("WITH RECURSIVE ", "WITH "):
        if sql.upper().startswith(word):
            return f"{word}{tables}, {sql[len(word):]}"
    return f"WITH {tables} {sql}"


def with_fixtures(sql: str, scans: bool = False) -> str:
    """The SQL with catalogue (and scans) as first common tables."""
    names = {n: n for n in _TABLES} | {"catalogue": "catalogue"}
    first = f"catalogue AS ({CATALOGUE.format(**names)})"
    if scans:
        first += f", scans AS ({SCANS.format(**names)})"
    return _after(first, sql)


RESULTS = """
SELECT s.scan_id, s.user_id, s.scanned_at, s.input_mode, s.device_id, s.location_label, s.inspection_id, s.client_uuid, s.raw_input,
  regexp_replace(upper(s.raw_input), '[^A-Z0-9]', ''{g}) AS normalized_input,
  CASE WHEN s.scan_id % 10 = 7 THEN NULL ELSE c.component_id END AS matched_component_id,
  CASE WHEN s.scan_id % 10 = 7 THEN 'not_found' WHEN c.is_chinese = 'YES' THEN 'chinese' WHEN c.is_chinese = 'NO' AND c.confidence_score >= 60 THEN 'non_chinese' ELSE 'unknown_origin' END AS result,
  CASE WHEN s.scan_id % 10 = 7 THEN '' ELSE c.criticality END AS criticality,
  CASE s.scan_id % 10 WHEN 2 THEN 'lot_code_stripped' WHEN 3 THEN 'ocr_corrected' WHEN 4 THEN 'ocr_folded' WHEN 5 THEN 'prefix' WHEN 6 THEN 'fuzzy' WHEN 7 THEN 'none' WHEN 8 THEN 'label_mpn' WHEN 9 THEN 'exact_code' ELSE 'normalized' END AS match_method,
  CAST(CASE s.scan_id % 10 WHEN 2 THEN 96 WHEN 3 THEN 94 WHEN 4 THEN 90 WHEN 5 THEN 88 WHEN 6 THEN 85.25 WHEN 7 THEN 0 ELSE 100 END AS DOUBLE) AS match_score
FROM {scans} s
JOIN (SELECT v.event_id, (v.event_id * 31 + v.user_id) % z.n + z.lo AS target FROM {events} v CROSS JOIN (SELECT count(*) AS n, min(p_partkey) AS lo FROM {part}) z) t ON t.event_id = s.scan_id
JOIN {catalogue} c ON c.ord = t.target
"""

WORDS = """
SELECT 'IMG-' || CAST(s.scan_id - s.scan_id % 20 AS STRING) AS image_id, w.text, CAST(60 + (s.scan_id * 7 + w.k) % 40 AS DOUBLE) AS confidence,
  'engine' || CAST(s.scan_id % 2 AS STRING) AS engine, 'variant' || CAST(s.scan_id % 3 AS STRING) AS variant, CASE WHEN w.k = 3 THEN 'line' ELSE 'word' END AS level, s.scan_id * 4 + w.k AS ord
FROM {scans} s CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k4
JOIN (SELECT scan_id, 0 AS k, raw_input AS text FROM {scans} UNION ALL SELECT scan_id, 1, 'GQ' || CAST(scan_id % 7 AS STRING) || 'J' FROM {scans}
  UNION ALL SELECT scan_id, 2, CASE scan_id % 4 WHEN 0 THEN 'CHN' WHEN 1 THEN '2219' WHEN 2 THEN 'ST' ELSE 'rohs' END FROM {scans}
  UNION ALL SELECT scan_id, 3, 'lot gq' || CAST(scan_id % 7 AS STRING) || 'j' FROM {scans}) w ON w.scan_id = s.scan_id AND w.k = k4.k
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan results as a fact table, assigned by arithmetic: input of the reports, which don't depend on how a scan was matched."""
    c = catalogue(spark, sf_dir)
    t = tables(spark, sf_dir, "part", "events")
    return spark.sql(RESULTS.replace("{g}", ""), scans=spark.sql(SCANS, catalogue=c, **t), catalogue=c, **t)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WORDS, scans=scans(spark, sf_dir))


def with_results(sql: str) -> str:
    names = {n: n for n in _TABLES} | {"catalogue": "catalogue", "scans": "scans", "g": ", 'g'"}
    return with_fixtures(_after(f"results AS ({RESULTS.format(**names)})", sql), scans=True)


def with_words(sql: str) -> str:
    return with_fixtures(_after(f"words AS ({WORDS.format(scans='scans')})", sql), scans=True)
