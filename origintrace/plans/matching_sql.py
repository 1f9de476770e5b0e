"""SQL of the whole match cascade, the verdict and the marking check, over the fixtures' catalogue and scans.

Each text is a list of common tables, to be put after the fixtures'. It states the rules one by one, as a reader of them would;
nothing of how the DataFrame version works is in it. Its edit distance is the engine's own (an edit inside a swapped pair may
count less there than in optimal string alignment; `marking_distances` has the latter in SQL).
"""

from __future__ import annotations

import re

from ..rules import tables as R
from .registry import cases, listed, quote

NORM = "regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g')"
_SEPARATED = r"'[\x1d\x1e\x04]'"

#: Label payloads: mpn and label_coo, the first value of each field of a structured label.
LABELS = f"""payload AS (SELECT *, starts_with(raw_input, '[)>') OR regexp_matches(raw_input, {_SEPARATED}) AS structured FROM scans),
fields AS (SELECT *, list_filter(list_transform(regexp_split_to_array(CASE WHEN starts_with(raw_input, '[)>') THEN substr(raw_input, 4) ELSE raw_input END, {_SEPARATED}), lambda p: trim(p)), lambda p: p <> '') AS parts FROM payload),
labels_read AS (SELECT *, CASE WHEN structured THEN trim(substr(list_filter(parts, lambda p: starts_with(upper(p), '1P') AND length(p) > 2)[1], 3)) END AS mpn,
  CASE WHEN structured THEN trim(substr(list_filter(parts, lambda p: starts_with(upper(p), '4L') AND length(p) > 2)[1], 3)) END AS label_coo FROM fields)"""


def _agreed(by: str, kind: str) -> str:
    known = "is_chinese <> 'UNKNOWN'"
    return f"""SELECT '{kind}', {by}, count(DISTINCT is_chinese) FILTER (WHERE {known}) <= 1, arg_max(component_id, struct_pack(a := {known}, b := confidence_score, c := -ord)), count(*), count(*) FILTER (WHERE {known}), string_agg(DISTINCT is_chinese, ', ' ORDER BY is_chinese) FILTER (WHERE {known}) FROM live WHERE search_key <> '' GROUP BY 2"""


LOOKUPS = f"""live AS (SELECT *, translate(search_key, '{R.FOLD_FROM}', '{R.FOLD_TO}') AS fold FROM catalogue WHERE NOT is_deleted),
lookups(kind, probe, agreed, best, n_rows, n_definite, verdicts) AS (SELECT 'B', upper(barcode), true, arg_max(component_id, ord), 1, 1, '' FROM live WHERE barcode <> '' GROUP BY 2
  UNION ALL SELECT 'Q', upper(qr_code), true, arg_max(component_id, ord), 1, 1, '' FROM live WHERE qr_code <> '' GROUP BY 2
  UNION ALL {_agreed("search_key", "K")} UNION ALL {_agreed("fold", "F")})"""

_FORWARD = cases("substr(norm, i, 1)", R.GLYPH_PAIRS)
_BACKWARD = cases("substr(norm, i, 1)", {b: a for a, b in R.GLYPH_PAIRS}.items())
_CHEAP = {1: ("exact_code", 100), 2: ("exact_code", 100), 3: ("exact_code", 100), 4: ("exact_code", 100), 5: ("normalized", 100), 6: ("label_mpn", 100), 7: ("lot_code_stripped", 96), 8: ("ocr_corrected", 94), 9: ("ocr_folded", 90), 10: ("ocr_folded_stripped", 87)}
_TEXT = "coalesce(mpn, raw_input)"

#: Optimal string alignment of the pairs of w (a, b) as d (a, b, distance): a row of the table for each character of a. A state
#: holds the row before, the one before that, and the row so far, which starts with its number. For recursive SQL.
OSA = """t(a, b, i, j, above2, above, cur) AS (SELECT a, b, 1, 0, CAST([] AS BIGINT[]), range(0, length(b) + 1), [CAST(1 AS BIGINT)] FROM w
  UNION ALL SELECT a, b, CASE WHEN j = length(b) THEN i + 1 ELSE i END, CASE WHEN j = length(b) THEN 0 ELSE j + 1 END, CASE WHEN j = length(b) THEN above ELSE above2 END, CASE WHEN j = length(b) THEN cur ELSE above END,
    CASE WHEN j = length(b) THEN [CAST(i + 1 AS BIGINT)] ELSE list_append(cur, least(above[j + 2] + 1, cur[j + 1] + 1, above[j + 1] + CASE WHEN substr(a, i, 1) = substr(b, j + 1, 1) THEN 0 ELSE 1 END,
      CASE WHEN i > 1 AND j > 0 AND substr(a, i, 1) = substr(b, j, 1) AND substr(a, i - 1, 1) = substr(b, j + 1, 1) THEN above2[j] + CASE WHEN substr(a, i, 1) = substr(b, j + 1, 1) THEN 0 ELSE 1 END ELSE 1000000 END)) END
  FROM t WHERE i <= length(a)),
d AS (SELECT a, b, CAST(cur[length(b) + 1] AS INT) AS distance FROM t WHERE i = length(a) AND j = length(b))"""

READINGS = f"""places AS (SELECT scan_id, norm, unnest(range(1, length(norm) + 1)) AS i FROM read_keys),
readings AS (SELECT scan_id, 0 AS place, norm AS variant FROM read_keys UNION ALL SELECT scan_id, 2 * i, substr(norm, 1, i - 1) || {_FORWARD} || substr(norm, i + 1) FROM places UNION ALL SELECT scan_id, 2 * i + 1, substr(norm, 1, i - 1) || {_BACKWARD} || substr(norm, i + 1) FROM places)"""

_LABEL_NOTES = f"CASE WHEN mpn IS NOT NULL THEN replace({quote(R.NOTES['label'])}, '%s', mpn) END, replace({quote(R.NOTES['label_coo'])}, '%s', nullif(label_coo, ''))"
_LEFT = "CAST(CASE WHEN h.n_definite > 0 THEN h.n_definite ELSE h.n_rows END AS VARCHAR)"
_ROW_NOTES = f"""CASE WHEN h.n_rows > 1 AND h.n_definite > 0 AND h.n_definite < h.n_rows THEN replace({quote(R.NOTES['superseded'])}, '%s', CAST(h.n_rows - h.n_definite AS VARCHAR)) END, CASE WHEN h.n_rows > 1 AND h.agreed THEN replace({quote(R.NOTES['agreed'])}, '%s', {_LEFT}) END,
  CASE WHEN NOT h.agreed THEN format({quote(R.NOTES['conflict'].replace('%s', '{}'))}, {_LEFT}, h.verdicts) END"""
_HOW = f"""CASE h.layer WHEN 7 THEN format({quote(R.NOTES['cut'].replace('%s', '{}'))}, norm, h.probe) WHEN 8 THEN format({quote(R.NOTES['glyph'].replace('%s', '{}'))}, norm, h.probe)
  WHEN 9 THEN format({quote(R.NOTES['fold'].replace('%s', '{}'))}, norm, h.probe) WHEN 10 THEN format({quote(R.NOTES['fold_cut'].replace('%s', '{}'))}, norm) END"""
_NAMED = f"CASE h.layer {' '.join(f"WHEN {n} THEN '{m}'" for n, (m, _) in _CHEAP.items())} END"
_NOTED = "array_to_string(list_filter([{0}], lambda x: x IS NOT NULL), ' | ')"

CASCADE = f"""{LABELS}, {LOOKUPS},
read_keys AS (SELECT scan_id, raw_input, mpn, label_coo, {NORM.format("raw_input")} AS own, {NORM.format(_TEXT)} AS norm,
  CASE WHEN NOT regexp_matches({_TEXT}, {_SEPARATED}) AND starts_with(upper({_TEXT}), '1P') AND length({_TEXT}) > 2 THEN {NORM.format(f"substr({_TEXT}, 3)")} END AS single FROM labels_read),
{READINGS},
cuts AS (SELECT scan_id, norm, unnest(range({R.TRUNCATION_FLOOR}, length(norm))) AS n FROM read_keys),
probes(scan_id, layer, place, kind, probe) AS (SELECT scan_id, 1, 0, 'B', upper(raw_input) FROM read_keys UNION ALL SELECT scan_id, 2, 0, 'Q', upper(raw_input) FROM read_keys
  UNION ALL SELECT scan_id, 3, 0, 'B', upper(mpn) FROM read_keys UNION ALL SELECT scan_id, 4, 0, 'Q', upper(mpn) FROM read_keys
  UNION ALL SELECT scan_id, 5, 0, 'K', norm FROM read_keys UNION ALL SELECT scan_id, 6, 0, 'K', single FROM read_keys
  UNION ALL SELECT scan_id, 7, -n, 'K', substr(norm, 1, n) FROM cuts
  UNION ALL SELECT scan_id, 8, place, 'K', variant FROM readings WHERE place > 0
  UNION ALL SELECT scan_id, 9, 0, 'F', translate(norm, '{R.FOLD_FROM}', '{R.FOLD_TO}') FROM read_keys
  UNION ALL SELECT scan_id, 10, -n, 'F', translate(substr(norm, 1, n), '{R.FOLD_FROM}', '{R.FOLD_TO}') FROM cuts),
first_hits AS (SELECT scan_id, arg_min(struct_pack(layer := layer, agreed := agreed, best := best, kind := kind, probe := probe, n_rows := n_rows, n_definite := n_definite, verdicts := verdicts), struct_pack(a := layer, b := place)) AS h FROM probes JOIN lookups USING (kind, probe) JOIN read_keys USING (scan_id) WHERE norm <> '' AND probe <> '' GROUP BY scan_id),
cheap AS (SELECT scan_id, CASE WHEN NOT h.agreed THEN 'conflict' WHEN h.layer = 5 AND mpn IS NOT NULL THEN 'label_mpn' ELSE {_NAMED} END AS method,
  CAST(CASE h.layer {" ".join(f"WHEN {n} THEN {s}" for n, (_, s) in _CHEAP.items())} END AS DOUBLE) AS score, CASE WHEN h.agreed THEN h.best END AS component_id,
  CASE WHEN h.layer <= 2 THEN own WHEN h.layer IN (6, 7, 8) THEN h.probe ELSE norm END AS normalized_input, CASE WHEN h.layer <= 2 THEN '' WHEN h.layer <= 4 THEN {_NOTED.format(_LABEL_NOTES)} ELSE {_NOTED.format(", ".join((_LABEL_NOTES, _HOW, _ROW_NOTES)))} END AS notes,
  h.kind, h.probe, h.agreed, h.n_rows, CASE WHEN h.layer IN (5, 6) THEN 'normalized' ELSE {_NAMED} END AS went FROM first_hits JOIN read_keys USING (scan_id)),
unread AS (SELECT scan_id, norm, mpn, label_coo FROM read_keys WHERE norm <> '' AND scan_id NOT IN (SELECT scan_id FROM cheap)),
begun AS (SELECT unread.*, l AS h, probe, agreed, best, n_rows, max(length(probe)) OVER (PARTITION BY scan_id) AS longest FROM unread JOIN lookups l ON kind = 'K' AND length(norm) >= {R.PREFIX_FLOOR} AND (starts_with(probe, norm) OR starts_with(norm, probe))),
prefixed AS (SELECT scan_id, CASE WHEN count(*) > 1 THEN 'ambiguous_prefix' WHEN bool_and(agreed) THEN 'prefix' ELSE 'conflict' END AS method, CASE WHEN count(*) > 1 THEN 0.0 ELSE 88.0 END AS score,
  CASE WHEN count(*) = 1 AND bool_and(agreed) THEN min(best) END AS component_id, min(norm) AS normalized_input,
  CASE WHEN count(*) > 1 THEN min({_NOTED.format(_LABEL_NOTES)}) || CASE WHEN min(mpn) IS NULL THEN '' ELSE ' | ' END || replace({quote(R.NOTES['ambiguous_prefix'])}, '%s', CAST(sum(n_rows) AS VARCHAR)) ELSE min({_NOTED.format(", ".join((_LABEL_NOTES, quote(R.NOTES['prefix']), _ROW_NOTES)))}) END AS notes,
  'K' AS kind, min(probe) AS probe, bool_and(agreed) AS agreed, CASE WHEN count(*) = 1 THEN min(n_rows) ELSE 0 END AS n_rows, 'prefix' AS went FROM begun WHERE length(probe) = longest GROUP BY scan_id),
unlike AS (SELECT * FROM unread WHERE scan_id NOT IN (SELECT scan_id FROM prefixed)),
asked AS (SELECT norm, unnest(list_distinct(list_transform(range(1, greatest(2, length(norm) - 1)), lambda i: substr(norm, i, 3)))) AS gram FROM (SELECT DISTINCT norm FROM unlike)),
stored AS (SELECT ord, search_key, unnest(list_distinct(list_transform(range(1, greatest(2, length(search_key) - 1)), lambda i: substr(search_key, i, 3)))) AS gram FROM live WHERE search_key <> ''),
alike AS (SELECT norm, ord, search_key, row_number() OVER (PARTITION BY norm ORDER BY count(*) DESC, ord) AS place FROM asked JOIN stored USING (gram) GROUP BY norm, ord, search_key QUALIFY place <= {R.FUZZY_SCANNED}),
w AS (SELECT DISTINCT norm AS a, search_key AS b FROM alike WHERE damerau_levenshtein(norm, search_key) < levenshtein(norm, search_key)),
{OSA},
measured AS (SELECT norm, ord, search_key, place, CAST(greatest(length(norm), length(search_key)) AS DOUBLE) AS longest, coalesce(distance, levenshtein(norm, search_key)) AS d, len(list_filter(range(1, least(length(norm), length(search_key)) + 1), lambda i: substr(norm, 1, i) = substr(search_key, 1, i))) AS same FROM alike LEFT JOIN d ON d.a = norm AND d.b = search_key),
likeness AS (SELECT *, CASE WHEN norm = search_key THEN 100.0 ELSE round_even((1.0 - d / longest) * 100 * 0.75 + same / longest * 100 * 0.25, 2) END AS s FROM measured),
ranked AS (SELECT norm, ord, s, row_number() OVER (PARTITION BY norm ORDER BY s DESC, place) AS r FROM likeness WHERE s >= {R.FUZZY_LEAST}),
nearest AS (SELECT norm, max(s) AS best, max(CASE WHEN r = 2 THEN s END) AS second, max(CASE WHEN r = 1 THEN ord END) AS ord FROM ranked WHERE r <= {R.FUZZY_KEPT} GROUP BY norm),
fuzzy AS (SELECT scan_id, norm, mpn, label_coo, CASE WHEN coalesce(best, 0) < {R.FUZZY_ACCEPT} THEN 'none' WHEN second >= best - {R.FUZZY_MARGIN} THEN 'ambiguous_fuzzy' ELSE 'fuzzy' END AS method, coalesce(best, 0.0) AS score, live.component_id AS nearest_id FROM unlike LEFT JOIN nearest USING (norm) LEFT JOIN live USING (ord)),
matches AS (SELECT * FROM cheap UNION ALL SELECT * FROM prefixed UNION ALL SELECT scan_id, method, score, CASE WHEN method = 'fuzzy' THEN nearest_id END, norm, {_NOTED.format(_LABEL_NOTES + f", CASE WHEN method = 'ambiguous_fuzzy' THEN {quote(R.NOTES['ambiguous_fuzzy'])} END")}, NULL, NULL, true, 0, 'fuzzy' FROM fuzzy
  UNION ALL SELECT scan_id, 'none', 0.0, NULL, '', {quote(R.NOTES['empty'])}, NULL, NULL, true, 0, '' FROM read_keys WHERE norm = '')"""

#: The other rows of each match: scan_id, rank, component_id, score, method.
TRAIL = f"""{CASCADE},
key_rows AS (SELECT kind, probe, ord, component_id, is_chinese = 'UNKNOWN' AS vague, bool_and(is_chinese = 'UNKNOWN') OVER (PARTITION BY kind, probe) AS all_vague FROM (SELECT 'K' AS kind, search_key AS probe, * FROM live WHERE search_key <> '' UNION ALL SELECT 'F', fold, * FROM live WHERE search_key <> '')),
key_places AS (SELECT kind, probe, component_id, row_number() OVER (PARTITION BY kind, probe ORDER BY ord) AS place FROM key_rows WHERE NOT vague OR all_vague),
prefix_held AS (SELECT scan_id, l.component_id, l.ord, min(l.ord) OVER (PARTITION BY scan_id, l.search_key) AS begins FROM begun JOIN prefixed USING (scan_id) JOIN live l ON l.search_key = begun.probe WHERE length(begun.probe) = longest AND method = 'ambiguous_prefix'),
prefix_rows AS (SELECT scan_id, component_id, row_number() OVER (PARTITION BY scan_id ORDER BY begins, ord) AS place FROM prefix_held)
SELECT scan_id, CASE WHEN agreed THEN place - 1 ELSE place END AS rank, p.component_id, score, went AS method FROM (SELECT * FROM matches WHERE n_rows > 1) m JOIN key_places p USING (kind, probe) WHERE NOT agreed OR place > 1
UNION ALL SELECT scan_id, place, component_id, {R.AMBIGUOUS_SCORE}, 'prefix' FROM prefix_rows WHERE place <= {R.AMBIGUOUS_KEPT}
UNION ALL SELECT scan_id, CASE WHEN method = 'fuzzy' THEN r - 1 ELSE r END, live.component_id, s, 'fuzzy' FROM fuzzy JOIN ranked USING (norm) JOIN live USING (ord) WHERE r <= 5 AND (method <> 'fuzzy' OR r > 1)"""


def marking_tables(source: str) -> str:
    """Tables up to `marked` (scan_id, code, codes, worst): what the marking check finds in source (scan_id, marking_text, maker,
    part_key, flag)."""
    site = lambda value: f"CASE {' '.join(f'WHEN mine = {quote(m)} AND {value} = {quote(c)} THEN {quote(k)}' for m, c, k, *_ in R.SITE_CODES)} END"
    inside = " ".join(f"WHEN contains(n, {quote(a)}) THEN {quote(c)}" for a, c in R.MARKING_ALIASES.items() if len(a) > 2)
    exact = " ".join(f"WHEN n = {quote(a)} THEN {quote(c)}" for a, c in reversed(R.MARKING_ALIASES.items()))
    phrases = " OR ".join(f"contains(whole, {quote(p)})" for p in R.MARKING_PHRASES)
    restricted = quote(R.RESTRICTED_CODE)
    return f"""raw_lines AS (SELECT *, list_filter(regexp_split_to_array(coalesce(marking_text, ''), '[\\r\\n|]+'), lambda x: regexp_matches(x, '\\S')) AS lines, {NORM.format("coalesce(part_key, '')")} AS k,
  trim(regexp_replace(replace(upper(coalesce(maker, '')), '.', ''), '\\s+', ' ', 'g')) AS n, upper(coalesce(nullif(flag, ''), 'UNKNOWN')) AS listed FROM {source}),
named AS (SELECT *, upper(array_to_string(lines, ' ')) AS whole, CASE {exact} {inside} ELSE n END AS mine, substr(k, 1, 6) AS head, right(k, 6) AS tail FROM raw_lines),
tokened AS (SELECT *, list_filter(flatten(list_transform(lines, lambda l: regexp_split_to_array(upper(l), '[^A-Z0-9]+'))), lambda t: t <> '' AND (head = '' OR (NOT contains(t, head) AND NOT contains(t, tail)))) AS toks FROM named),
coded AS (SELECT *, coalesce(list_filter(toks, lambda t: t IN ({listed(R.COUNTRY_CODES)}))[1], CASE WHEN {phrases} THEN {restricted} END) AS code FROM tokened),
sited AS (SELECT *, list_filter(toks, lambda t, i: list_position(toks, t) = i AND {site("t")} IS NOT NULL) AS sites FROM coded),
found AS (SELECT *, list_filter(list_concat([CASE WHEN code = {restricted} AND listed = 'NO' THEN 'unit_marked_china_catalogue_non_chinese' END, CASE WHEN code = {restricted} AND listed <> 'NO' THEN 'unit_marked_china' END,
    CASE WHEN code <> {restricted} AND listed = 'YES' THEN 'country_code_disagrees_with_catalogue' END],
  list_transform(sites, lambda t: CASE WHEN {site("t")} = 'diffusion' THEN 'china_wafer_fab_code' WHEN code IS NULL THEN 'china_assembly_site_code' WHEN code <> {restricted} THEN 'site_code_contradicts_country_code' END),
  [CASE WHEN code IS NULL AND mine IN ({listed(R.PRINTS_COUNTRY)}) AND len(lines) >= 3 THEN 'country_code_missing' END]), lambda x: x IS NOT NULL) AS codes FROM sited),
marked AS (SELECT *, CASE WHEN list_has_any(codes, ['unit_marked_china_catalogue_non_chinese', 'unit_marked_china', 'site_code_contradicts_country_code', 'china_assembly_site_code']) THEN 'red' WHEN len(codes) > 0 THEN 'yellow' ELSE 'info' END AS worst FROM found)"""


def _policy(result: str) -> str:
    dash = "CASE WHEN pol <> '' THEN ' - ' || pol ELSE {0} END"
    return f"""CASE WHEN {result} = 'chinese' AND crit = 'CRITICAL' THEN 'NOT ACCEPTABLE' || {dash.format("' in a CRITICAL subsystem'")}
  WHEN {result} = 'chinese' AND crit = 'NON-CRITICAL' THEN 'PERMITTED BY POLICY' || {dash.format("''")} || ' (Chinese origin recorded; non-critical subsystem)'
  WHEN {result} = 'chinese' THEN 'REFER TO INSPECTING AUTHORITY - subsystem not classified in the policy matrix' WHEN {result} = 'non_chinese' THEN 'ACCEPTABLE - no Chinese-origin evidence for this marking'
  WHEN {result} = 'unknown_origin' THEN 'REQUIRES MANUAL REVIEW - origin or identity not established' ELSE 'NOT IN CATALOGUE - REQUIRES MANUAL REVIEW' END"""


TIER = """CASE WHEN is_chinese NOT IN ('YES', 'NO') OR trim(country_of_origin) = '' OR upper(country_of_origin) = 'UNKNOWN' THEN 'none'
  WHEN category = 'OEM / LRU' OR contains(upper(verification_source), 'OEM LANDSCAPE') THEN 'manufacturer' ELSE 'component' END"""

VERDICTS = f"""{CASCADE},
evidence AS (SELECT m.*, c.component_id IS NOT NULL AS hit, c.is_chinese, coalesce(nullif(upper(c.criticality), ''), 'REVIEW') AS crit, trim(c.criticality_policy) AS pol, c.manufacturer, c.search_key,
  CASE WHEN upper(trim(c.country_of_origin)) IN ({listed(R.UNKNOWN_AT_VERDICT)}) THEN '' ELSE trim(c.country_of_origin) END AS country, least(c.confidence_score, m.score) AS eff, {TIER.replace("is_chinese", "c.is_chinese")} AS tier, m.method IN ({listed(R.UNCERTAIN_METHODS)}) AS unsure
  FROM matches m LEFT JOIN catalogue c USING (component_id)),
ruled AS (SELECT *, CASE WHEN NOT hit THEN 'not_found' WHEN is_chinese = 'YES' THEN 'chinese' WHEN is_chinese = 'NO' AND country <> '' AND eff >= {R.CONFIDENCE_FLOOR} AND tier <> 'manufacturer' AND NOT unsure THEN 'non_chinese' ELSE 'unknown_origin' END AS result,
  CASE WHEN NOT hit THEN 'COMPONENT NOT FOUND' WHEN is_chinese = 'YES' AND unsure THEN 'PROBABLE CHINESE COMPONENT - CONFIRM MARKING' WHEN is_chinese = 'YES' AND tier = 'manufacturer' THEN 'CHINESE MANUFACTURER - COMPONENT ORIGIN PRESUMED CHINESE'
    WHEN is_chinese = 'YES' THEN 'CHINESE COMPONENT DETECTED' WHEN is_chinese <> 'NO' OR country = '' THEN 'ORIGIN NOT FOUND' WHEN eff < {R.CONFIDENCE_FLOOR} THEN 'ORIGIN NOT CONFIRMED' WHEN tier = 'manufacturer' THEN 'OEM NON-CHINESE - COMPONENT ORIGIN NOT DOCUMENTED'
    WHEN unsure THEN 'IDENTITY UNCERTAIN - REQUIRES MANUAL REVIEW' ELSE 'NON-CHINESE COMPONENT' END AS headline FROM evidence),
to_mark AS (SELECT r.scan_id, s.marking_text, r.manufacturer AS maker, r.search_key AS part_key, r.is_chinese AS flag FROM ruled r JOIN scans s USING (scan_id)),
{marking_tables("to_mark")},
tight AS (SELECT r.*, m.worst, m.worst = 'red' AND result NOT IN ('not_found', 'chinese') AS raised, m.worst = 'yellow' AND result = 'non_chinese' AS fallen, m.worst IN ('red', 'yellow') AND result <> 'not_found' AS touched FROM ruled r JOIN marked m USING (scan_id)),
final AS (SELECT *, CASE WHEN raised THEN 'chinese' WHEN fallen THEN 'unknown_origin' ELSE result END AS verdict FROM tight)
SELECT scan_id, method AS match_method, score AS match_score, component_id AS matched_component_id, verdict AS result, CASE verdict WHEN 'chinese' THEN 'RED' WHEN 'non_chinese' THEN 'GREEN' WHEN 'unknown_origin' THEN 'YELLOW' ELSE 'GREY' END AS banner,
  CASE WHEN raised THEN 'CHINESE ORIGIN MARKED ON PACKAGE' WHEN fallen THEN 'MARKING INCONSISTENT' ELSE headline END AS headline, CASE WHEN hit THEN round_even(eff, 1) ELSE 0.0 END AS confidence,
  CASE WHEN worst = 'red' AND touched THEN 'unit_marking' WHEN hit THEN tier ELSE 'none' END AS origin_evidence, touched OR NOT hit OR unsure OR result <> 'non_chinese' AS review_required,
  {_policy("verdict")} AS policy_decision, verdict = 'chinese' AND crit = 'CRITICAL' AND hit AS escalate, worst FROM final"""

_BANNER = "CASE result WHEN 'chinese' THEN 'RED' WHEN 'non_chinese' THEN 'GREEN' WHEN 'unknown_origin' THEN 'YELLOW' ELSE 'GREY' END"


def _banners(catalogue: str) -> str:
    """scan_id, banner of every scan against a catalogue, before its package is looked at."""
    rules = VERDICTS[: VERDICTS.index("to_mark AS (")].rstrip().rstrip(",")
    return f"WITH RECURSIVE {re.sub(r'\bcatalogue\b', catalogue, rules)} SELECT scan_id, {_BANNER} AS banner FROM ruled"


#: A later version of the catalogue: some rows' origins are corrected, some rows go, some keys change.
LATER = """SELECT * REPLACE (CASE WHEN ord % 31 = 3 THEN 'YES' WHEN ord % 37 = 5 THEN 'UNKNOWN' ELSE is_chinese END AS is_chinese, is_deleted OR ord % 41 = 7 AS is_deleted, CASE WHEN ord % 53 = 9 THEN search_key || 'X' ELSE search_key END AS search_key) FROM catalogue"""

DISAGREEMENTS = f"""WITH later AS ({LATER}), a AS ({_banners("catalogue")}), b AS ({_banners("later")})
SELECT scan_id, a.banner AS device_banner, b.banner AS server_banner FROM a JOIN b USING (scan_id) WHERE a.banner <> b.banner"""
