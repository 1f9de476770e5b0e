"""Consistency of a package's other marking lines with its catalogue record, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import tables as R
from .origin import policy_decision

_EMPTY = "array<struct<code:string,severity:string,message:string>>"


def canonical_maker(name: Column) -> Column:
    """By alias, else the first alias of over two letters that the name holds, else the name."""
    n = F.trim(F.regexp_replace(F.replace(F.upper(F.coalesce(name, F.lit(""))), F.lit("."), F.lit("")), r"\s+", " "))
    out = n
    for alias, canon in reversed([x for x in R.MARKING_ALIASES.items() if len(x[0]) > 2]):
        out = F.when(n.contains(alias), canon).otherwise(out)
    for alias, canon in R.MARKING_ALIASES.items():
        out = F.when(n == alias, canon).otherwise(out)
    return out


def raw_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\r\n|]+"), lambda x: x.rlike(r"\S"))


def tokens(text: Column, part_key: Column) -> Column:
    return tokens_of(raw_lines(text), part_key)


def tokens_of(lines: Column, part_key: Column) -> Column:
    """Upper-case alphanumeric tokens in reading order, without those that hold the first or last six characters of the part."""
    key = F.regexp_replace(F.upper(F.coalesce(part_key, F.lit(""))), "[^A-Z0-9]", "")
    head, tail = F.substring(key, 1, 6), F.when(F.length(key) >= 6, F.substring(key, -6, 6)).otherwise(key)
    every = F.flatten(F.transform(lines, lambda line: F.split(F.upper(line), "[^A-Z0-9]+")))
    return F.filter(every, lambda t: (t != "") & ((head == "") | (~t.contains(head) & ~t.contains(tail))))


def country_code(text: Column, part_key: Column) -> Column:
    return code_of(raw_lines(text), tokens(text, part_key))


def code_of(lines: Column, toks: Column) -> Column:
    """The first token that is a country code; else the restricted one, if the whole text has one of its phrases; else null."""
    codes = F.filter(toks, lambda t: t.isin(list(R.COUNTRY_CODES)))
    whole = F.upper(F.array_join(lines, " "))
    phrase = F.lit(False)
    for p in R.MARKING_PHRASES:
        phrase = phrase | whole.contains(p)
    return F.coalesce(F.try_element_at(codes, F.lit(1)), F.when(phrase, R.RESTRICTED_CODE))


def site_codes(text: Column, maker: Column, part_key: Column) -> Column:
    return sites_of(tokens(text, part_key), canonical_maker(maker))


def sites_of(toks: Column, mine: Column) -> Column:
    known = F.lit(False)

    def is_site(t: Column) -> Column:
        hit = known
        for m, code, *_ in R.SITE_CODES:
            hit = hit | ((mine == m) & (t == code))
        return hit

    return F.array_distinct(F.filter(toks, is_site))


def _finding(name: str, severity: str, **put: Column | str) -> Column:
    """A finding with its text from the rules, columns or words put into the braces."""
    parts = re.split(r"\{(\w+)\}", R.FINDING_TEXTS[name])
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    text = F.concat(*[lit(put[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)])
    return F.struct(F.lit(name).alias("code"), F.lit(severity).alias("severity"), text.alias("message"))


def marked(rows: DataFrame, text: Column, maker: Column, part_key: Column, flag: Column) -> DataFrame:
    """rows with country_code, country, site_codes, findings and worst (info, yellow or red) of a package's whole marking text.

    Lines, tokens and codes are columns of their own on the way, so each is made once a row."""
    out = rows.withColumns({"mk_lines": raw_lines(text), "mk_mine": canonical_maker(maker), "mk_flag": flag})
    out = out.withColumn("mk_tokens", tokens_of(F.col("mk_lines"), part_key))
    out = out.withColumns({"country_code": code_of(F.col("mk_lines"), F.col("mk_tokens")), "site_codes": sites_of(F.col("mk_tokens"), F.col("mk_mine"))})
    out = out.withColumn("findings", _findings(F.col("country_code"), F.col("site_codes"), F.col("mk_mine"), F.col("mk_flag"), F.size("mk_lines")))
    out = out.withColumns({"country": _country(F.col("country_code")), "worst": _worst(F.col("findings"))})
    return out.drop("mk_lines", "mk_mine", "mk_flag", "mk_tokens")


def analyse(text: Column, maker: Column, part_key: Column, flag: Column) -> dict[str, Column]:
    """The columns of `marked` as expressions of one step."""
    code, sites, mine = country_code(text, part_key), site_codes(text, maker, part_key), canonical_maker(maker)
    findings = _findings(code, sites, mine, flag, F.size(raw_lines(text)))
    return {"country_code": code, "country": _country(code), "site_codes": sites, "findings": findings, "worst": _worst(findings)}


def _country(code: Column) -> Column:
    return F.coalesce(*[F.when(code == k, v) for k, v in R.COUNTRY_CODES.items()])


def _worst(findings: Column) -> Column:
    has = lambda severity: F.exists(findings, lambda f: f["severity"] == severity)
    return F.when(has("red"), "red").when(has("yellow"), "yellow").otherwise("info")


def _findings(code: Column, sites: Column, mine: Column, flag: Column, n_lines: Column) -> Column:
    cat = F.upper(F.coalesce(F.nullif(flag, F.lit("")), F.lit("UNKNOWN")))
    country = _country(code)
    restricted = F.coalesce(code == R.RESTRICTED_CODE, F.lit(False))
    found = [
        F.when(restricted & (cat == "NO"), _finding("unit_marked_china_catalogue_non_chinese", "red")),
        F.when(restricted & (cat != "NO"), _finding("unit_marked_china", "red")),
        F.when(code.isNotNull() & ~restricted & (cat == "YES"), _finding("country_code_disagrees_with_catalogue", "yellow", code=code, country=country)),
    ]

    def of_site(t: Column) -> Column:
        out = F.lit(None).cast("struct<code:string,severity:string,message:string>")
        for m, known, kind, where, site, source in R.SITE_CODES:
            here, put = (mine == m) & (t == known), {"site_code": known, "site": site, "source": source}
            if kind == "assembly":
                for severity, serious in (("red", restricted | F.lit(where == R.RESTRICTED_CODE)), ("yellow", ~restricted & F.lit(where != R.RESTRICTED_CODE))):
                    out = F.when(here & code.isNotNull() & (code != where) & serious, _finding("site_code_contradicts_country_code", severity, code=code, **put)).otherwise(out)
                if where == R.RESTRICTED_CODE:
                    out = F.when(here & code.isNull(), _finding("china_assembly_site_code", "red", **put)).otherwise(out)
            elif where == R.RESTRICTED_CODE:
                out = F.when(here, _finding("china_wafer_fab_code", "yellow", **put)).otherwise(out)
        return out

    missing = F.when(code.isNull() & mine.isin(R.PRINTS_COUNTRY) & (n_lines >= 3), _finding("country_code_missing", "yellow"))
    return F.array_compact(F.concat(F.array(*found), F.transform(sites, of_site), F.array(missing))).cast(_EMPTY)


def tighten(verdict: Column, worst: Column, findings: Column) -> dict[str, Column]:
    """A verdict (struct) made stricter by the marking's findings, never laxer; one on nothing found is left alone."""
    v = verdict
    red = (worst == "red") & (v["result"] != "not_found")
    new_red = red & (v["result"] != "chinese")
    yellow = (worst == "yellow") & (v["result"] != "not_found")
    fall = yellow & (v["result"] == "non_chinese")
    touched = red | yellow
    said = F.array_join(F.slice(F.transform(F.filter(findings, lambda f: f["severity"] == worst), lambda f: f["message"]), 1, 2), " ")
    result = F.when(new_red, "chinese").when(fall, "unknown_origin").otherwise(v["result"])
    pick = lambda a, b, c: F.when(new_red, a).when(fall, b).otherwise(c)
    escalate = F.when(new_red, v["criticality"] == "CRITICAL").otherwise(v["escalate"])
    return {
        "result": result,
        "banner": pick("RED", "YELLOW", v["banner"]),
        "headline": pick(R.HEADLINES["marked"], R.HEADLINES["inconsistent"], v["headline"]),
        "action": pick(R.ACTIONS["marked"], R.ACTIONS["inconsistent"], v["action"]),
        "alert": pick(F.lit(True), F.lit(False), v["alert"]),
        "criticality": v["criticality"],
        "confidence": v["confidence"],
        "origin_evidence": F.when(red, "unit_marking").otherwise(v["origin_evidence"]),
        "evidence_detail": F.when(touched & (said != ""), said).otherwise(v["evidence_detail"]),
        "review_required": touched | v["review_required"],
        "policy_decision": F.when(touched, policy_decision(result, v["criticality"], v["criticality_policy"])).otherwise(v["policy_decision"]),
        "escalate": escalate,
        "escalation_note": F.when(new_red & escalate, "Chinese-origin marking on a CRITICAL subsystem part").when(new_red, "").otherwise(v["escalation_note"]),
    }
