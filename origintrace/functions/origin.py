"""Origin rules: what a catalogue row's evidence says, and the verdict on a scan, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import tables as R
from .text import any_of, strip


def _text(c: Column) -> Column:
    return strip(c)


def _flag(c: Column) -> Column:
    up = F.upper(F.coalesce(c, F.lit("")))
    return F.when(up == "", "UNKNOWN").otherwise(up)


def derive_origin(country: Column, remarks: Column, declared: Column) -> Column:
    """YES, NO or UNKNOWN: the declared flag, else a phrase in country and remarks, else what the country says."""
    d = F.upper(_text(declared))
    blob = F.upper(F.concat(F.coalesce(country, F.lit("")), F.lit(" "), F.coalesce(remarks, F.lit(""))))
    c = F.upper(_text(country))
    return (
        F.when(d.isin(R.DECLARED_YES), "YES")
        .when(d.isin(R.DECLARED_NO), "NO")
        .when(any_of(blob, R.RESTRICTED_PHRASES), "YES")
        .when((c == "") | c.isin(R.UNKNOWN_AT_IMPORT), "UNKNOWN")
        .when(any_of(c, R.RESTRICTED_COUNTRIES), "YES")
        .otherwise("NO")
    )


def seed_origin(country: Column, remarks: Column) -> Column:
    """The older rule of the seed worksheets: no list of unknown countries, and territories as parts between slashes."""
    blob = F.upper(F.concat(F.coalesce(country, F.lit("")), F.lit(" "), F.coalesce(remarks, F.lit(""))))
    c = _text(F.upper(country))
    listed = F.arrays_overlap(F.split(c, "/"), F.array(*[F.lit(t) for t in R.TERRITORIES]))
    return F.when(any_of(blob, R.SEED_PHRASES), "YES").when(c == "", "UNKNOWN").when(listed | any_of(c, R.SEED_CONTAINS), "YES").otherwise("NO")


def evidence_tier(flag: Column, country: Column, category: Column, source: Column) -> Column:
    """none, manufacturer or component: what the row's origin claim rests on."""
    c = _text(country)
    none = ~_flag(flag).isin("YES", "NO") | (c == "") | (F.upper(c) == "UNKNOWN")
    maker = F.upper(_text(category)).isin(R.MAKER_LEVEL_CATEGORIES) | any_of(F.upper(_text(source)), R.MAKER_LEVEL_SOURCES)
    return F.when(none, "none").when(maker, "manufacturer").otherwise("component")


def evidence_detail(tier: Column, country: Column, source: Column, by: Column) -> Column:
    recorded = F.coalesce(F.nullif(_text(source), F.lit("")), F.lit("not recorded"))
    who = F.when(_text(by) != "", F.concat(F.lit("; verified by "), _text(by))).otherwise("")
    return (
        F.when(tier == "none", "The catalogue record has no documented country of origin.")
        .when(tier == "manufacturer", F.concat(F.lit("Manufacturer/OEM home country only ("), _text(country), F.lit("); source: "), recorded, F.lit(". This is not the component's documented place of manufacture.")))
        .otherwise(F.concat(F.lit("Catalogue record: "), _text(country), F.lit("; source: "), recorded, who, F.lit(".")))
    )


def policy_decision(result: Column, criticality: Column, policy: Column) -> Column:
    crit, pol = F.upper(F.coalesce(criticality, F.lit(""))), _text(policy)
    dash = F.when(pol != "", F.concat(F.lit(" - "), pol))
    return (
        F.when((result == "chinese") & (crit == "CRITICAL"), F.concat(F.lit("NOT ACCEPTABLE"), F.coalesce(dash, F.lit(" in a CRITICAL subsystem"))))
        .when((result == "chinese") & (crit == "NON-CRITICAL"), F.concat(F.lit("PERMITTED BY POLICY"), F.coalesce(dash, F.lit("")), F.lit(" (Chinese origin recorded; non-critical subsystem)")))
        .when(result == "chinese", "REFER TO INSPECTING AUTHORITY - subsystem not classified in the policy matrix")
        .when(result == "non_chinese", "ACCEPTABLE - no Chinese-origin evidence for this marking")
        .when(result == "unknown_origin", "REQUIRES MANUAL REVIEW - origin or identity not established")
        .otherwise("NOT IN CATALOGUE - REQUIRES MANUAL REVIEW")
    )


BANNERS = {"chinese": "RED", "non_chinese": "GREEN", "unknown_origin": "YELLOW", "not_found": "GREY"}


def banner_of(result: Column) -> Column:
    return F.when(result == "chinese", "RED").when(result == "non_chinese", "GREEN").when(result == "unknown_origin", "YELLOW").otherwise("GREY")


def verdict(component: Column, score: Column, method: Column) -> dict[str, Column]:
    """Columns of the verdict on a matched component (a struct of catalogue fields, null if there is none).

    The rules in order: no component; the flag; then, for what is still a clean pass, the confidence floor, evidence of the
    manufacturer only, and an uncertain match; a restricted one is renamed for these but stays restricted.
    """
    c = lambda name: F.coalesce(component[name].cast("string"), F.lit(""))
    found = component.isNotNull()
    flag = _flag(component["is_chinese"])
    country = F.when(F.upper(_text(component["country_of_origin"])).isin(R.UNKNOWN_AT_VERDICT), "").otherwise(_text(component["country_of_origin"]))
    crit = F.upper(F.coalesce(F.nullif(component["criticality"], F.lit("")), F.lit("REVIEW")))
    effective = F.least(F.coalesce(component["confidence_score"].cast("double"), F.lit(0.0)), score)
    tier = evidence_tier(component["is_chinese"], component["country_of_origin"], component["category"], component["verification_source"])
    uncertain = F.coalesce(method.isin(R.UNCERTAIN_METHODS), F.lit(False))
    restricted, clean = flag == "YES", (flag == "NO") & (country != "")
    low, maker = effective < R.CONFIDENCE_FLOOR, tier == "manufacturer"
    result = F.when(~found, "not_found").when(restricted, "chinese").when(clean & ~low & ~maker & ~uncertain, "non_chinese").otherwise("unknown_origin")
    percent = lambda x: F.format_string("%.0f", F.bround(x, 0))
    headline = (
        F.when(~found, R.HEADLINES["not_found"])
        .when(restricted & uncertain, R.HEADLINES["restricted_uncertain"])
        .when(restricted & maker, R.HEADLINES["restricted_maker"])
        .when(restricted, R.HEADLINES["restricted"])
        .when(~clean, R.HEADLINES["no_origin"])
        .when(low, R.HEADLINES["low"])
        .when(maker, R.HEADLINES["maker"])
        .when(uncertain, R.HEADLINES["uncertain"])
        .otherwise(R.HEADLINES["clean"])
    )
    by = F.concat(F.lit("Matched by '"), method, F.lit("' at "), percent(score), F.lit("%. "))
    action = (
        F.when(~found, R.ACTIONS["not_found"])
        .when(restricted & uncertain, F.concat(by, F.lit(R.ACTIONS["restricted_uncertain"])))
        .when(restricted & maker, R.ACTIONS["restricted_maker"])
        .when(restricted, "")
        .when(~clean, R.ACTIONS["no_origin"])
        .when(low, F.concat(F.lit("Match confidence "), percent(effective), F.lit(f"% is below the {R.CONFIDENCE_FLOOR:.0f}% floor - verify manually")))
        .when(maker, R.ACTIONS["maker"])
        .when(uncertain, F.concat(by, F.lit(R.ACTIONS["uncertain"])))
        .otherwise("")
    )
    escalate = (result == "chinese") & (crit == "CRITICAL")
    return {
        "result": result,
        "banner": banner_of(result),
        "headline": headline,
        "action": action,
        "alert": result == "chinese",
        "criticality": F.when(found, crit).otherwise(""),
        "criticality_policy": c("criticality_policy"),
        "confidence": F.when(found, F.bround(effective, 1)).otherwise(0.0),
        "origin_evidence": F.when(found, tier).otherwise("none"),
        "evidence_detail": F.when(found, evidence_detail(tier, component["country_of_origin"], component["verification_source"], component["verified_by"])).otherwise(""),
        "review_required": ~found | uncertain | (result != "non_chinese"),
        "policy_decision": policy_decision(result, F.when(found, crit).otherwise(""), c("criticality_policy")),
        "escalate": escalate,
        "escalation_note": F.when(escalate, F.coalesce(F.nullif(component["criticality_policy"], F.lit("")), F.lit("Chinese origin not acceptable in this subsystem"))).otherwise(""),
    }


def banner_line(headline: Column, result: Column) -> Column:
    """The line under a banner: by the headline's first words, as several reasons share a result, else by the result."""
    line = F.when(headline == R.WEAK_HEADLINE, R.WEAK_LINE)
    for start, text in R.BANNER_LINES:
        line = line.when(headline.startswith(start), text)
    named = F.create_map(*[F.lit(x) for pair in R.RESULT_LINES.items() for x in pair])
    return F.coalesce(line, F.try_element_at(named, result), F.lit(""))
