"""Queries that write files and read them again: each format's round trip over the whole catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue
from ..session import scratch_path
from ..sources import readers, sinks
from . import fixtures as fx
from .registry import cat, query, scan

_TEXT = ["component_id", "component_name", "part_number", "manufacturer", "country_of_origin", "remarks"]
_SAME = f"SELECT {', '.join(f'trim({c}) AS {c}' for c in _TEXT)} FROM catalogue"


def _rows(spark, sf_dir):
    return fx.catalogue(spark, sf_dir).select("ord", *_TEXT)


@query(_SAME, cat)
def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    sinks.write_csv(_rows(spark, sf_dir), path, _TEXT)
    return readers.read_delimited(spark, path, ",").select(*_TEXT)


@query(_SAME, cat)
def worksheet_round_trip(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    _rows(spark, sf_dir).drop("ord").write.csv(path, sep="\t", header=True, quote='"', escape='"')
    return readers.read_worksheet(spark, path).select(*_TEXT)


@query(_SAME, cat)
def json_round_trip(spark, sf_dir):
    """The export as JSON documents, read as an import file of several documents."""
    path = scratch_path(spark, "json")
    sinks.write_documents(sinks.json_documents(_rows(spark, sf_dir), "ord", "2024-01-31T00:00:00+00:00", 1, 500), path)
    return readers.read_json(spark, path).select(*_TEXT)


@query(_SAME, cat)
def sql_dump_round_trip(spark, sf_dir):
    """INSERT statements of some hundred rows each, one a file, between statements that are no concern."""
    path = scratch_path(spark, "sql")
    quoted = F.concat(F.lit("("), F.concat_ws(", ", *[F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'")) for c in _TEXT]), F.lit(")"))
    chunks = _rows(spark, sf_dir).groupBy(F.floor(F.col("ord") / 500).alias("chunk")).agg(F.array_join(F.collect_list(quoted), ",\n").alias("tuples"))
    head = F.lit(f"-- a dump\nCREATE TABLE parts (id text);\nINSERT INTO parts ({', '.join(_TEXT)}) VALUES\n")
    sinks.write_documents(chunks.select(F.concat(head, "tuples", F.lit(";\nDROP TABLE other;\n")).alias("value")), path)
    return readers.read_sql_dump(spark, path).select(*_TEXT)


@query("""SELECT floor(ord / 500)::BIGINT AS chunk, sha256('{"exported_at":"2024-01-31T00:00:00+00:00","revision":3,"components":[' || string_agg('{"component_id":"' || component_id || '","confidence_score":' || CAST(confidence_score AS VARCHAR) || ',"is_deleted":' || CAST(is_deleted AS VARCHAR) || '}', ',' ORDER BY ord) || ']}') AS digest FROM catalogue GROUP BY 1""", cat)
def json_exports(spark, sf_dir):
    """The export's documents, with their time and revision."""
    rows = fx.catalogue(spark, sf_dir).select("ord", "component_id", "confidence_score", "is_deleted")
    return sinks.json_documents(rows, "ord", "2024-01-31T00:00:00+00:00", 3, 500).select("chunk", F.sha2("value", 256).alias("digest"))


@query("SELECT component_id, is_chinese FROM catalogue WHERE NOT is_deleted AND is_chinese = 'YES'", cat)
def exported_catalogue(spark, sf_dir):
    return sinks.catalogue_export(fx.catalogue(spark, sf_dir), "YES").select("component_id", "is_chinese")


@query("SELECT component_id, category, 'restored' AS version FROM catalogue UNION ALL SELECT component_id, CASE WHEN is_chinese = 'UNKNOWN' THEN 'store' ELSE category END, 'copied' FROM catalogue", cat)
def restored_catalogue(spark, sf_dir):
    """A version saved, changed, and restored: the restored rows, and the copy of what was there before the restore."""
    root = scratch_path(spark, "versions")
    c = fx.catalogue(spark, sf_dir)
    sinks.save_version(c, root, 1)
    changed = catalogue.bulk_update(c, c.where("is_chinese = 'UNKNOWN'"), category="store")
    back = sinks.restore_version(spark, root, changed, 1, 2)
    columns = ["component_id", "category"]
    return back.select(*columns, F.lit("restored").alias("version")).unionByName(sinks.read_version(spark, root, 2).select(*columns, F.lit("copied").alias("version")))


@query("""SELECT 'rows' AS what, count(*) AS n FROM catalogue UNION ALL SELECT 'csv', count(*) FROM catalogue UNION ALL SELECT 'json', count(*) FROM catalogue UNION ALL SELECT 'restricted', count(*) FILTER (WHERE is_chinese = 'YES') FROM catalogue UNION ALL SELECT 'critical', count(*) FILTER (WHERE criticality = 'CRITICAL') FROM catalogue""", cat)
def seed_files(spark, sf_dir):
    """What the seed's files hold when they are read again."""
    places = sinks.write_seed(fx.catalogue(spark, sf_dir), scratch_path(spark, "seed"))
    counted = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    summary = spark.read.parquet(places["summary"])
    out = counted(spark.read.parquet(places["parquet"]), "rows").unionByName(counted(readers.read_delimited(spark, places["csv"], ","), "csv")).unionByName(counted(readers.read_json(spark, places["json"]), "json"))
    return out.unionByName(summary.select(F.lit("restricted").alias("what"), F.col("yes").alias("n"))).unionByName(summary.select(F.lit("critical").alias("what"), F.col("critical").alias("n")))


@query("""WITH n AS (SELECT scan_id, strftime(scanned_at, '%Y%m%d') AS day, CASE WHEN scan_id % 5 = 0 THEN 'scan' ELSE 'req' || CAST(scan_id % 3 AS VARCHAR) END AS name FROM scans), p AS (SELECT *, row_number() OVER (PARTITION BY day, name ORDER BY scan_id) - 1 AS k FROM n)
SELECT scan_id, 'scans/' || day || '/' || name || CASE WHEN k > 0 THEN '-' || CAST(k AS VARCHAR) ELSE '' END || '.jpg' AS path FROM p""", scan)
def evidence_paths(spark, sf_dir):
    """Where photographs are kept; names are cleaned, and none overwrites another."""
    uuid = F.when(F.col("scan_id") % 5 == 0, "../ .").otherwise(F.concat(F.lit("/re q."), (F.col("scan_id") % 3).cast("string")))
    return readers.evidence_paths(fx.scans(spark, sf_dir).withColumn("uuid", uuid), "uuid", "scanned_at", "scan_id").select("scan_id", "path")


@query("""SELECT source, version, count(*) FILTER (WHERE NOT is_deleted) AS live, count(*) FILTER (WHERE category = 'store') AS stored FROM (SELECT 'server' AS source, 3 AS version, is_deleted, CASE WHEN is_chinese = 'UNKNOWN' THEN 'store' ELSE category END AS category FROM catalogue) GROUP BY 1, 2""", cat)
def resolved_version(spark, sf_dir):
    """The catalogue that a device takes of those saved: the server's before the import's, cached and bundled ones, the newest of it."""
    root = scratch_path(spark, "versions")
    c = fx.catalogue(spark, sf_dir)
    sinks.save_version(c.where("not is_deleted"), root, 9, "bundled")
    sinks.save_version(c, root, 2)
    sinks.save_version(catalogue.bulk_update(c, c.where("is_chinese = 'UNKNOWN'"), category="store"), root, 3)
    sinks.save_version(c.where("is_chinese = 'YES'"), root, 8, "import")
    taken = readers.newest(sinks.manifest(spark, root)).first()
    rows = sinks.read_version(spark, root, taken.version)
    return rows.agg(F.count_if(~F.col("is_deleted")).alias("live"), F.count_if(F.col("category") == "store").alias("stored")).select(F.lit(taken.source).alias("source"), F.lit(taken.version).alias("version"), "live", "stored")


@query(_SAME, cat)
def workbook_round_trip(spark, sf_dir):
    """The catalogue as workbooks with a title row, read again by the rule that finds the header."""
    return readers.parse_xlsx(sinks.workbooks(_rows(spark, sf_dir), "ord", "Catalogue", 500)).select(*_TEXT)


_REPORT = ["component_id", "component_name", "is_chinese", "confidence_score"]


@query(f"""WITH b AS (SELECT floor(ord / 400)::BIGINT AS chunk, count(*) AS n, sha256(string_agg('component_id=' || component_id || '|component_name=' || component_name || '|confidence_score=' || CAST(confidence_score AS VARCHAR) || '|is_chinese=' || is_chinese, '' ORDER BY ord)) AS digest FROM catalogue GROUP BY 1)
SELECT chunk, 'Origin-' || chunk || '.xlsx' AS name, 'COMPONENT ID,COMPONENT NAME,IS CHINESE,CONFIDENCE SCORE' AS header, n AS records, 'Report body SHA-256: ' || digest AS footer FROM b""", cat)
def workbook_reports(spark, sf_dir):
    """Reports of the catalogue as workbooks: each one's header and the digest of its body, read from the workbook itself."""
    rows = fx.catalogue(spark, sf_dir).select("ord", *_REPORT)
    books = sinks.workbooks(rows, "ord", "Origin", 400, {"generated_at": "2024-01-31", "generated_by": "system", "db_revision": 3})

    def read(frames):
        import pandas as pd

        for pdf in frames:
            for chunk, name, content in zip(pdf["chunk"], pdf["name"], pdf["content"], strict=True):
                sheet = next(iter(readers.sheets(bytes(content)).values()))
                at = readers.header_row(sheet)
                yield pd.DataFrame([(chunk, name, ",".join(sheet[at]), sum(1 for r in sheet[at + 1 :] if len(r) > 1), sheet[-1][0])], columns=["chunk", "name", "header", "records", "footer"])

    return books.mapInPandas(read, "chunk long, name string, header string, records long, footer string")
