"""Dashboards, trends, rankings and reports over scan results. as_of is always given: results depend on data alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import hmac_sha256
from ..session import cut

RESULTS = ["chinese", "non_chinese", "unknown_origin", "not_found"]


def since(as_of: str, days: int) -> Column:
    """The trailing window's start: so many times 24 hours before, not a calendar day."""
    return F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))


def window(scans: DataFrame, as_of: str, days: int) -> DataFrame:
    return scans.where(F.col("scanned_at") >= since(as_of, days))


def scan_counters(scans: DataFrame, as_of: str, inspections: DataFrame | None = None) -> DataFrame:
    """One row of counts over the last day and week and, with inspections (status), of open inspections."""
    at = F.col("scanned_at")
    counted = scans.agg(F.count_if(at >= since(as_of, 1)).alias("scans_today"), F.count_if(at >= since(as_of, 7)).alias("scans_7d"), F.count_if((at >= since(as_of, 7)) & (F.col("result") == "chinese")).alias("chinese_hits_7d"))
    return counted if inspections is None else counted.withColumn("open_inspections", F.lit(inspections.where("status = 'open'").count()).cast("long"))


def scan_history(scans: DataFrame, as_of: str, days: int = 30, result: str = "", inspection: str = "", user: str = "") -> DataFrame:
    """Scans of the window; of one result, inspection or user where it is given."""
    out = window(scans, as_of, days)
    for column, value in (("result", result), ("inspection_id", inspection), ("user_id", user)):
        out = out.where(F.col(column) == value) if value else out
    return out


def listed_inspections(inspections: DataFrame, status: str = "", inspector: str = "", n: int = 100) -> DataFrame:
    """The n inspections that started last; of one status or inspector where it is given."""
    for column, value in (("status", status), ("inspector_id", inspector)):
        inspections = inspections.where(F.col(column) == value) if value else inspections
    return inspections.orderBy(F.desc("started_at"), F.desc("inspection_number")).limit(n)


def log_entries(log: DataFrame, as_of: str, days: int = 30, action: str = "", n: int = 200) -> DataFrame:
    """The last n entries of the window, of one action where it is given."""
    out = log.where(F.col("occurred_at") >= since(as_of, days))
    return (out.where(F.col("action") == action) if action else out).orderBy(F.desc("sequence")).limit(n)


def own_queue(queued: DataFrame, sessions: DataFrame) -> DataFrame:
    """Queued scans (device_id, user_id) whose user is the one signed in on the device (sessions: device_id, user_id); the others
    wait for theirs."""
    return queued.join(sessions.select("device_id", "user_id").distinct(), ["device_id", "user_id"], "left_semi")


def recent(scans: DataFrame, n: int = 10) -> DataFrame:
    return scans.orderBy(F.desc("scanned_at"), F.desc("scan_id")).limit(n)


def critical_alerts(scans: DataFrame, n: int = 10) -> DataFrame:
    return recent(scans.where("result = 'chinese' AND criticality = 'CRITICAL'"), n).withColumn("message", F.lit("Chinese-origin part in a CRITICAL subsystem"))


def mixes(scans: DataFrame) -> DataFrame:
    """mix, value, n of results, input modes and match methods, in one pass."""
    pairs = F.array(*[F.struct(F.lit(m).alias("mix"), F.col(c).alias("value")) for m, c in (("result", "result"), ("input_mode", "input_mode"), ("match_method", "match_method"))])
    return scans.select(F.explode(pairs).alias("p")).groupBy("p.mix", "p.value").agg(F.count(F.lit(1)).alias("n"))


def daily_trend(scans: DataFrame) -> DataFrame:
    return scans.groupBy(F.date_format("scanned_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("scans"), F.count_if(F.col("result") == "chinese").alias("chinese"))


def monthly_trend(scans: DataFrame) -> DataFrame:
    """A row a month, a column a result; null where the result did not occur."""
    return scans.groupBy(F.date_format("scanned_at", "yyyy-MM").alias("month")).pivot("result", RESULTS).agg(F.count(F.lit(1)))


def heat_map(scans: DataFrame) -> DataFrame:
    """Restricted hits by place and weekday, Monday 0."""
    place = F.coalesce(F.nullif("location_label", F.lit("")), F.lit("unspecified"))
    return scans.where("result = 'chinese'").groupBy(place.alias("location"), F.weekday("scanned_at").alias("weekday")).agg(F.count(F.lit(1)).alias("hits"))


def most_detected(scans: DataFrame, catalogue: DataFrame, n: int = 15) -> DataFrame:
    """The components most often found restricted; ties by id."""
    hits = scans.where("result = 'chinese' AND matched_component_id IS NOT NULL").groupBy(F.col("matched_component_id").alias("component_id")).agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(catalogue.select("component_id", "component_name", "manufacturer", "drone_subsystem"), "component_id", "left").orderBy(F.desc("hits"), "component_id").limit(n)


def top_manufacturers(scans: DataFrame, catalogue: DataFrame, n: int = 15) -> DataFrame:
    """Restricted hits by maker; a component that is gone counts for unknown, a blank maker stays blank."""
    hits = scans.where("result = 'chinese' AND matched_component_id IS NOT NULL").groupBy(F.col("matched_component_id").alias("component_id")).agg(F.count(F.lit(1)).alias("h"))
    named = hits.join(catalogue.select("component_id", F.coalesce("manufacturer", F.lit("")).alias("manufacturer")), "component_id", "left")
    return named.groupBy(F.coalesce("manufacturer", F.lit("unknown")).alias("manufacturer")).agg(F.sum("h").alias("hits")).orderBy(F.desc("hits"), "manufacturer").limit(n)


def most_scanned(scans: DataFrame, n: int = 15) -> DataFrame:
    return scans.where("matched_component_id IS NOT NULL").groupBy(F.col("matched_component_id").alias("component_id")).agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "component_id").limit(n)


# --- reports ---


def inspection_report(scans: DataFrame, catalogue: DataFrame) -> DataFrame:
    c = catalogue.select("component_id", "component_name", "manufacturer", "country_of_origin")
    text = lambda x: F.coalesce(x, F.lit("")).alias(x)
    return scans.join(c, scans["matched_component_id"] == c["component_id"], "left").select(
        "scan_id", F.date_format("scanned_at", "yyyy-MM-dd HH:mm").alias("scanned_at"), "raw_input", "normalized_input", text("matched_component_id"), text("component_name"), text("manufacturer"), text("country_of_origin"),
        "result", "criticality", "match_method", F.bround("match_score", 1).alias("match_score"), "location_label",
    )


def origin_report(catalogue: DataFrame, flag: str) -> DataFrame:
    """Live rows of one origin; critical ones first, by subsystem and name: the order is in the column place.

    The rows are dealt over ranges of that order and written; a row's place is that inside its range after the rows of the ranges
    before, which are one row each of a small table. No task sees more than one range.
    """
    order = ["late", "drone_subsystem", "component_name", "component_id"]
    columns = ["component_id", "component_name", "chip_number", "manufacturer", "country_of_origin", "drone_subsystem", "criticality", "verification_source", "remarks"]
    rows = catalogue.where((~F.col("is_deleted")) & (F.col("is_chinese") == flag)).select(*columns, (F.col("criticality") != "CRITICAL").cast("int").alias("late"))
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "origin-report")
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", before.alias("before"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.join(offsets, "range").select(*columns, (F.col("before") + inside).alias("place"))


def statistics_report(counters: DataFrame, scans: DataFrame, days: int, revision: int) -> DataFrame:
    """metric, value: the catalogue's counters, the results' counts, the revision."""
    names = counters.columns
    first = counters.select(F.explode(F.array(*[F.struct(F.lit(n.replace("_", " ").title()).alias("metric"), F.col(n).cast("long").alias("value")) for n in names])).alias("m")).select("m.*")
    second = scans.groupBy("result").agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit(f"Scans ({days}d): "), "result").alias("metric"), "value")
    third = counters.sparkSession.range(1).select(F.lit("Database revision").alias("metric"), F.lit(revision).cast("long").alias("value"))
    return first.unionByName(second).unionByName(third)


def monthly_report(scans: DataFrame) -> DataFrame:
    result = lambda r: F.count_if(F.col("result") == r)
    return scans.groupBy(F.date_format("scanned_at", "yyyy-MM").alias("month")).agg(
        F.count_distinct(F.nullif("inspection_id", F.lit(""))).alias("inspections"), F.count(F.lit(1)).alias("scans"), result("chinese").alias("chinese_hits"), result("unknown_origin").alias("unknown"), result("not_found").alias("not_found"), F.count_distinct("user_id").alias("distinct_inspectors"),
    )


def body_digest(rows: DataFrame, order: list[str], group: str | None = None) -> DataFrame:
    """SHA-256 over the rows in order, each as name=value pairs by name joined by bars; group makes one digest a report.

    A report's rows are sorted by Spark, which may spill, and hashed as they pass: none is gathered, whatever the report's size.
    The digest is one chain over the text, so a report is hashed by one task."""
    columns = sorted(c for c in rows.columns if c != group)
    line = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in columns])
    places = [f"order_{i}" for i in range(len(order))]
    listed = rows.select(F.col(group) if group else F.lit(0).alias("report"), *[F.col(c).alias(p) for c, p in zip(order, places, strict=True)], line.alias("line"))
    by = group or "report"
    dealt = listed.repartition(by) if group else listed.repartition(1)
    lines = dealt.sortWithinPartitions(by, *places, "line").select(by, "line")
    digests = lines.select(F.col(by).alias("report"), "line").mapInArrow(_hashed(lines.schema[by].dataType), T.StructType([T.StructField("report", lines.schema[by].dataType), T.StructField("digest", T.StringType())]))
    if group:
        return digests.select(F.col("report").alias(group), "digest")
    return digests.select("digest").unionByName(rows.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.sha2(F.lit(""), 256).alias("digest")))


def _hashed(kind: T.DataType):
    """Lines of each report together and in order -> one digest a report."""
    import hashlib

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind), pa.string()]

    def digests(batches):
        last, chain, started = None, hashlib.sha256(), False

        def done():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((last, chain.hexdigest()), types, strict=True)], names=["report", "digest"])

        for batch in batches:
            for report, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if started and report != last:
                    yield done()
                    chain = hashlib.sha256()
                last, started = report, True
                chain.update(line.encode("utf-8", "surrogatepass"))
        if started:
            yield done()

    return digests


# --- inspections ---


def inspection_tally(scans: DataFrame) -> DataFrame:
    """inspection_id, total and a map of results' counts, as it is read; and whether anything restricted was found."""
    return scans.where("inspection_id IS NOT NULL").groupBy("inspection_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("result") == r).alias(r) for r in RESULTS])


def sign_off(tally: DataFrame, verdicts: DataFrame) -> DataFrame:
    """inspections (inspection_id, verdict) with status: a clear verdict over restricted finds is rejected; they escalate others."""
    joined = verdicts.join(tally, "inspection_id", "left")
    bad = F.coalesce(F.col("chinese"), F.lit(0)) > 0
    return joined.select("inspection_id", "verdict", F.when(bad & (F.col("verdict") == "clear"), "rejected").when(bad, "escalated").otherwise("completed").alias("status"))


def sign_inspections(rows: DataFrame, secret: bytes, user: Column, payload: Column) -> DataFrame:
    return rows.withColumn("signature", hmac_sha256(secret, F.concat(user, F.lit("|"), payload)))


def next_number(inspections: DataFrame, year: int) -> DataFrame:
    return inspections.where(F.col("inspection_number").startswith(f"INSP-{year}-")).agg((F.count(F.lit(1)) + 1).alias("next_number"))
