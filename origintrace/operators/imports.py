"""Staged import: header mapping, validation, derivation, duplicates, diff against the live catalogue, commit and rollback.

Every step is a DataFrame; nothing is written before commit, and commit makes the next version and the pre-images to undo it.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.origin import derive_origin
from ..rules import tables as R

_ISSUE = "struct<row_number:int,field:string,severity:string,message:string,value:string>"


def clean_header(h: str) -> str:
    return " ".join(re.sub(r"[_-]+", " ", h.strip().lower()).split())


def _names(field: str) -> tuple[str, ...]:
    return (field.replace("_", " "), *R.HEADER_NAMES[field])


def sequence_likeness(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def edit_likeness(a: str, b: str) -> float:
    """The device's: one minus the edits (with swaps) over the longer length; nothing is like an empty text."""
    if not a or not b:
        return 0.0
    row, above, before = list(range(len(b) + 1)), [], []
    for i, x in enumerate(a):
        before, above, row = above, row, [i + 1]
        for j, y in enumerate(b):
            swap = before[j - 1] + (x != y) if i and j and x == b[j - 1] and a[i - 1] == y else len(a) + len(b)
            row.append(min(above[j + 1] + 1, row[j] + 1, above[j] + (x != y), swap))
    return 1 - row[-1] / max(len(a), len(b))


def map_headers(columns: list[str], likeness=sequence_likeness) -> tuple[dict[str, str], list[str]]:
    """(header -> field, headers left over), by a table of all pairs of them: a known name scores above all likenesses, other pairs
    their best likeness to one of the field's names, if it is enough. Known names are taken in the file's order, then the file's
    headers in turn take their best free field (of equals, the first); a header and a field are taken once."""
    cleaned = {c: clean_header(c) for c in columns}
    place = {f: i for i, f in enumerate(R.HEADER_NAMES)}
    known = [(0, i, place[f], c, f) for i, c in enumerate(columns) for f in R.HEADER_NAMES if cleaned[c] in _names(f)]
    scored = [(max(likeness(cleaned[c], n) for n in _names(f)), c, f) for c in columns for f in R.HEADER_NAMES]
    like = [(1, columns.index(c), -s, place[f], c, f) for s, c, f in scored if s >= R.HEADER_LIKENESS]
    mapping: dict[str, str] = {}
    for *_, c, f in [*sorted(known), *sorted(like)]:
        if c not in mapping and f not in mapping.values():
            mapping[c] = f
    return mapping, [c for c in columns if c not in mapping and cleaned[c] not in R.IGNORED_HEADERS]


def apply_mapping(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """row_number and the canonical fields; headers left over are put behind the remarks as name: value."""
    of = {f: c for c, f in mapping.items()}
    value = lambda c: X.strip(F.col(f"`{c}`").cast("string"))
    extras = [F.when(value(c) != "", F.concat(F.lit(f"{c}: "), value(c))) for c in raw.columns if c not in mapping and c != "row_number" and clean_header(c) not in R.IGNORED_HEADERS]
    note = F.concat_ws("; ", *extras) if extras else F.lit("")
    fields = {f: value(of[f]) if f in of else F.lit("") for f in R.FIELDS}
    own = fields["remarks"]
    fields["remarks"] = F.when(note == "", own).when(own == "", note).otherwise(F.concat(own, F.lit(" | "), note))
    return raw.select("row_number", *[c.alias(f) for f, c in fields.items()])


def issues(n: str = "row_number") -> Column:
    """Array of what is wrong with a mapped row: errors keep it out, warnings don't."""

    def one(test: Column, field: str, severity: str, message: str, value: Column | None = None) -> Column:
        made = F.struct(F.col(n).cast("int").alias("row_number"), F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), (F.lit("") if value is None else value).alias("value"))
        return F.when(test, made)

    number = F.col("confidence_score").try_cast("double")
    blank = lambda c: F.col(c) == ""
    return F.array_compact(
        F.array(
            one(blank("component_name"), "component_name", "error", "required field is empty"),
            one(blank("part_number") & blank("chip_number"), "part_number", "error", "row has neither a part number nor a chip number, so it can never be matched by a scan"),
            one(~blank("confidence_score") & F.coalesce((number < 0) | (number > 100) | F.isnan(number), F.lit(True)), "confidence_score", "error", "must be a number between 0 and 100", F.col("confidence_score")),
            one(~F.upper("military_grade").isin("YES", "NO", ""), "military_grade", "warning", "expected YES or NO; value ignored", F.col("military_grade")),
            one(~blank("barcode") & ~F.col("barcode").rlike(R.BARCODE_SHAPE), "barcode", "warning", "unusual characters for a barcode payload", F.col("barcode")),
            one(blank("country_of_origin") & blank("remarks"), "country_of_origin", "warning", "no origin evidence - row will import as UNKNOWN (yellow banner)"),
        )
    ).cast(f"array<{_ISSUE}>")


def stage(raw: DataFrame, existing: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Each row of the file with bucket (new, updated, unchanged, duplicate, invalid), changed (field -> from, to), issues and
    first_seen_row (of a duplicate). raw: row_number (the header is row 1) and text columns. Blank cells never overwrite; a
    missing confidence is 100."""
    mapping = map_headers([c for c in raw.columns if c != "row_number"])[0] if mapping is None else mapping
    rows = apply_mapping(raw, mapping).withColumn("issues", issues())
    rows = rows.withColumn("invalid", F.exists("issues", lambda i: i["severity"] == "error"))
    rows = rows.withColumns({
        "is_chinese": derive_origin(F.col("country_of_origin"), F.col("remarks"), F.col("is_chinese")),
        "manufacturer": X.manufacturer_key(F.col("manufacturer")),
        "search_key": X.normalize(F.coalesce(F.nullif("chip_number", F.lit("")), "part_number")),
        "confidence_score": F.coalesce(F.col("confidence_score").try_cast("double"), F.lit(100.0)),
    })
    rows = rows.withColumn("component_id", F.coalesce(F.nullif("component_id", F.lit("")), X.component_id(F.col("chip_number"), F.col("part_number"), F.col("component_name"), F.col("manufacturer"))))
    seen = Window.partitionBy("component_id", "invalid").orderBy("row_number")
    rows = rows.withColumn("first_seen_row", F.first("row_number").over(seen))
    known = [c for c in R.COMPARED if c in existing.columns]
    live = existing.select(F.col("component_id"), F.struct(*known).alias("live"))
    rows = rows.join(live, "component_id", "left")
    as_text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    differs = [F.when((as_text(F.col(f"live.{c}")) != as_text(F.col(c))) & (as_text(F.col(c)) != ""), F.struct(F.lit(c).alias("key"), F.struct(as_text(F.col(f"live.{c}")).alias("from"), as_text(F.col(c)).alias("to")).alias("value"))) for c in known]
    rows = rows.withColumn("changed", F.map_from_entries(F.array_compact(F.array(*differs))))
    bucket = F.when(F.col("invalid"), "invalid").when(F.col("first_seen_row") < F.col("row_number"), "duplicate").when(F.col("live").isNull(), "new").when(F.size("changed") > 0, "updated").otherwise("unchanged")
    return rows.withColumn("bucket", bucket).drop("live", "invalid")


def missing_in_file(staged: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids of live rows that the file does not hold."""
    return existing.select("component_id").join(staged.where("bucket IN ('new', 'updated', 'unchanged')").select("component_id"), "component_id", "left_anti")


def summary(staged: DataFrame) -> DataFrame:
    """Counts of buckets; invalid rows are counted by their error issues."""
    errors = F.size(F.filter("issues", lambda i: i["severity"] == "error"))
    count = lambda b: F.count_if(F.col("bucket") == b)
    return staged.agg(
        F.count_if(F.col("bucket") != "invalid").alias("rows_total"), count("new").alias("rows_new"), count("updated").alias("rows_updated"), count("unchanged").alias("rows_unchanged"), count("duplicate").alias("rows_duplicate"),
        F.coalesce(F.sum(errors), F.lit(0)).alias("rows_invalid"), F.count_if((F.col("bucket") == "updated") & F.map_contains_key("changed", "is_chinese")).alias("origin_flips"),
    )


def origin_counts(staged: DataFrame) -> DataFrame:
    ok = F.col("bucket") != "invalid"
    return staged.agg(*[F.count_if(ok & (F.col("is_chinese") == f)).alias(f.lower()) for f in ("YES", "NO", "UNKNOWN")])


def commit(catalogue: DataFrame, staged: DataFrame, batch_id: str, delete_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(next version, revisions). catalogue has component_id, the fields, search_key, revision and is_deleted. New rows come in,
    changed fields are overwritten and the revision is raised; missing rows are soft-deleted on request. revisions hold the
    pre-image of each row touched (null for a new one), so the commit can be undone."""
    fields = [c for c in catalogue.columns if c not in ("component_id", "revision", "is_deleted")]
    fresh = staged.where("bucket IN ('new', 'updated')").select("component_id", "bucket", "changed", F.struct(*[F.col(c) for c in fields if c in staged.columns]).alias("after"))
    gone = missing_in_file(staged, catalogue.where("not is_deleted")).withColumn("gone", F.lit(delete_missing))
    image = F.struct(*[F.col(f"c.{c}") for c in catalogue.columns]).alias("before")
    joined = catalogue.alias("c").withColumn("present", F.lit(True)).select("component_id", "present", image).join(fresh, "component_id", "full").join(gone, "component_id", "left")
    new, touched, dropped = F.col("present").isNull(), F.col("bucket") == "updated", F.coalesce("gone", F.lit(False))

    def value(c: str) -> Column:
        kept = F.col(f"before.{c}")
        if c not in staged.columns:
            return kept.alias(c)
        written = F.col(f"after.{c}").cast(catalogue.schema[c].dataType)
        changes = F.map_contains_key(F.coalesce("changed", F.create_map().cast("map<string,struct<from:string,to:string>>")), c)
        follows = touched if c == "search_key" else touched & changes
        return F.when(new | follows, written).otherwise(kept).alias(c)

    version = joined.select(
        "component_id", *[value(c) for c in fields],
        F.when(new, 1).otherwise(F.col("before.revision") + (F.coalesce(touched, F.lit(False)) | dropped).cast("int")).alias("revision"),
        F.when(new, False).otherwise(F.col("before.is_deleted") | dropped).alias("is_deleted"),
    ).select(catalogue.columns)
    operation = F.when(new, "create").when(dropped, "delete").otherwise("update")
    revisions = joined.where(new | touched | dropped).select(F.lit(batch_id).alias("batch_id"), "component_id", operation.alias("operation"), F.when(~new, F.col("before")).alias("before"), F.map_keys("changed").alias("changed_fields"))
    return version, revisions


def rollback(catalogue: DataFrame, revisions: DataFrame, batch_id: str) -> DataFrame:
    """The version without the batch: rows it created go, the others get their pre-images back."""
    batch = revisions.where(F.col("batch_id") == batch_id)
    rest = catalogue.join(batch.select("component_id"), "component_id", "left_anti").select(catalogue.columns)
    return rest.unionByName(batch.where("operation <> 'create'").select("before.*").select(catalogue.columns))
