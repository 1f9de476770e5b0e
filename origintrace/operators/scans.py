"""Scan results: match, verdict and marking check of a batch of scans, as one fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.marking import marked, tighten
from ..functions.origin import verdict
from ..rules import tables as R
from ..session import cut
from .cascade import CARRIED, lookups, marking_key, matched_texts, prefixed_keys, probes
from .fuzzy import resembling

VERDICT_FIELDS = ["result", "banner", "headline", "action", "alert", "criticality", "confidence", "origin_evidence", "evidence_detail", "review_required", "policy_decision", "escalate", "escalation_note"]


def judged(matches: DataFrame) -> DataFrame:
    """matches (component, score, method) with a verdict struct; those without a component have none found."""
    made = verdict(F.col("component"), F.col("score"), F.col("method"))
    return matches.withColumn("verdict", F.struct(*[c.alias(n) for n, c in made.items()]))


def scan_results(scans: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The scans' columns with match_method, match_score, matched_component_id, notes, suggestions, resolved, the verdict after the marking check,
    and the check's country_code, site_codes, findings and worst. Distinct raw texts are judged once, and scans are dealt once, by these."""
    verdicts = judged(matched_texts(scans, catalogue)).withColumnRenamed("method", "match_method").withColumnRenamed("score", "match_score")
    joined = scans.withColumn("raw_text", F.coalesce("raw_input", F.lit(""))).join(verdicts.hint("merge"), "raw_text")
    joined = marked(joined, F.col("marking_text"), F.col("component.manufacturer"), F.col("component.search_key"), F.col("component.is_chinese"))
    tight = tighten(F.col("verdict"), F.col("worst"), F.col("findings"))
    return joined.select(
        *scans.columns, "normalized_input", "match_method", "match_score", F.col("component.component_id").alias("matched_component_id"), "notes", "suggestions", "resolved",
        "country_code", "site_codes", "findings", "worst", *[tight[f].alias(f) for f in VERDICT_FIELDS],
    )


def repeat_scans(scans: DataFrame, minutes: int = R.REPEAT_MINUTES) -> DataFrame:
    """scans with is_repeat: the same device read the same marking within so many minutes before."""
    before = Window.partitionBy("device_id", "normalized_input").orderBy("scanned_at", "scan_id")
    gap = F.col("scanned_at").cast("double") - F.lag("scanned_at").over(before).cast("double")
    return scans.withColumn("is_repeat", F.coalesce(gap <= minutes * 60, F.lit(False)))


def first_of_each(scans: DataFrame, uuid: str = "client_uuid") -> DataFrame:
    """scans with status: the first of a client_uuid (by time, then id) is accepted, its replays are duplicates, and one without is
    failed. Those without are no group: they don't come into the window."""
    order = Window.partitionBy(uuid).orderBy("scanned_at", "scan_id")
    named = F.coalesce(F.col(uuid), F.lit("")) != ""
    told = scans.where(named).withColumn("status", F.when(F.row_number().over(order) == 1, "accepted").otherwise("duplicate"))
    return told.unionByName(scans.where(~named).withColumn("status", F.lit("failed")))


def not_found_queue(results: DataFrame) -> DataFrame:
    """Open queue of markings without a component: hits, first raw input and time; keyed by normalised marking."""
    lost = results.where("result = 'not_found'")
    return lost.groupBy("normalized_input").agg(
        F.count(F.lit(1)).alias("hit_count"), F.min_by("raw_input", F.struct("scanned_at", "scan_id")).alias("raw_input"),
        F.min_by("user_id", F.struct("scanned_at", "scan_id")).alias("reported_by"), F.min("scanned_at").alias("created_at"),
    )


def touched(texts: DataFrame, mine: DataFrame, theirs: DataFrame, raw: str = "raw_input") -> DataFrame:
    """Of distinct raw texts those whose match may differ between two versions of the catalogue.

    A text is touched if one of its probes is a key that the versions resolve differently. One without a key in either may
    differ by what comes after: if a changed key begins it, or it begins one, or if it shares a gram with the key of a changed row and some key is like it at all.
    """
    return _touched(texts, _version(mine), _version(theirs), raw)


def _version(catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A catalogue's live rows, and what they are looked up by."""
    live = cut(catalogue.where("not is_deleted") if "is_deleted" in catalogue.columns else catalogue, "version")
    return live, cut(lookups(live), "version-lookups")


def _touched(texts: DataFrame, mine: tuple[DataFrame, DataFrame], theirs: tuple[DataFrame, DataFrame], raw: str) -> DataFrame:
    versions, looked_up = zip(mine, theirs, strict=True)
    a, b = (x.select("kind", "probe", F.struct("agreed", "component", "n_rows").alias(n)) for x, n in zip(looked_up, ("a", "b"), strict=True))
    changed = cut(a.join(b, ["kind", "probe"], "full").where("not (a <=> b)").select("kind", "probe"), "changed-keys")
    x, y = (v.select("component_id", F.struct("ord", *CARRIED).alias(n)) for v, n in zip(versions, ("a", "b"), strict=True))
    moved = x.join(y, "component_id", "full").where("not (a <=> b)").select(F.explode(F.array("a.search_key", "b.search_key")).alias("search_key")).where("search_key <> ''").distinct()

    known = cut(a.select("kind", "probe").unionByName(b.select("kind", "probe")).distinct(), "version-keys")
    asked = cut(probes(texts, known, raw, raw).select(raw, "kind", "probe"), "asked-probes")
    direct = asked.join(changed.hint("merge"), ["kind", "probe"], "left_semi").select(raw)
    resolved = asked.join(looked_up[0].select("kind", "probe").hint("merge"), ["kind", "probe"], "left_semi").select(raw)
    label = X.label_fields(F.col(raw))
    later = texts.join(direct.unionByName(resolved).distinct().hint("merge"), raw, "left_anti").select(raw, marking_key(F.col(raw), label).alias("norm"))
    later = cut(later.where("norm <> ''"), "asked-later")
    markings = cut(later.select("norm").distinct(), "asked-markings")
    keys = changed.where("kind = 'K'").withColumn("n_rows", F.lit(1).cast("long"))
    prefixed = prefixed_keys(markings, keys).select("norm")
    shared = moved.select(F.explode(X.grams(F.col("search_key"))).alias("gram")).distinct()
    like = resembling(markings, known.where("kind = 'K'").select(F.col("probe").alias("search_key")), R.FUZZY_LEAST)
    near = like.select("norm", F.explode(X.grams(F.col("norm"))).alias("gram")).join(shared, "gram", "left_semi").select("norm")
    return direct.unionByName(later.join(prefixed.unionByName(near).distinct().hint("merge"), "norm", "left_semi").select(raw)).distinct()


def disagreements(scans: DataFrame, mine: DataFrame, theirs: DataFrame, key: str = "scan_id", raw: str = "raw_input") -> DataFrame:
    """key, device_banner, server_banner of scans whose banner differs between two versions of the catalogue. Only texts that the
    versions' differences touch are matched again, once each."""
    texts = scans.select(F.coalesce(F.col(raw), F.lit("")).alias(raw)).distinct()
    versions = _version(mine), _version(theirs)
    texts = cut(_touched(texts, *versions, raw), "touched")
    a, b = (judged(matched_texts(texts, c, raw, looked_up)).select(F.col("raw_text").alias(raw), F.col("verdict.banner").alias(n)) for (c, looked_up), n in zip(versions, ("device_banner", "server_banner"), strict=True))
    differ = a.join(b.hint("merge"), raw).where("device_banner <> server_banner")
    return scans.select(key, F.coalesce(F.col(raw), F.lit("")).alias(raw)).join(differ, raw).select(key, "device_banner", "server_banner")
