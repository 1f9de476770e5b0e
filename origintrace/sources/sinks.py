"""Exports: CSV, JSON, XLSX, and versioned catalogue snapshots."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogue import seed_summary
from ..rules import tables as R


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Header always; a byte-order mark starts the header, as spreadsheet programs want it."""
    out = rows.select(columns or rows.columns)
    out.toDF("﻿" + out.columns[0], *out.columns[1:]).write.csv(path, header=True, quote='"', escape='"')


def catalogue_export(catalogue: DataFrame, flag: str | None = None) -> DataFrame:
    """Live rows without internal columns, of one origin if it is given."""
    out = catalogue.where(~F.col("is_deleted")).drop("id", "source_batch_id", "ord")
    return out.where(F.col("is_chinese") == flag) if flag else out


def as_json(rows: DataFrame) -> DataFrame:
    """A JSON text a row, nulls kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def json_documents(rows: DataFrame, order: str, exported_at: str, revision: int, rows_each: int = 1000) -> DataFrame:
    """The export as JSON documents {exported_at, revision, components: [...]}, each of at most rows_each rows, so that none is
    gathered whole: chunk (the document's number) and value. Rows are dealt by the order column's number, an integer."""
    chunk = F.floor(F.col(order) / rows_each).cast("long")
    one = F.to_json(F.struct(*[c for c in rows.columns if c != order]), {"ignoreNullFields": "false"})
    listed = rows.select(chunk.alias("chunk"), F.struct(F.col(order).alias("o"), one.alias("json")).alias("r")).groupBy("chunk").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["json"]), ",")
    head = F.lit('{"exported_at":"' + exported_at + '","revision":' + str(revision) + ',"components":[')
    return listed.select("chunk", F.concat(head, body, F.lit("]}")).alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One file a document."""
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)


_FONTS = '<fonts count="6"><font><sz val="10"/><name val="Arial"/></font><font><b/><sz val="12"/><color rgb="FFC00000"/><name val="Arial"/></font><font><b/><sz val="14"/><name val="Arial"/></font><font><i/><sz val="9"/><name val="Arial"/></font><font><b/><sz val="10"/><color rgb="FFFFFFFF"/><name val="Arial"/></font><font><i/><sz val="8"/><name val="Arial"/></font></fonts>'
_FILLS = '<fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>' + "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in R.SHEET_COLOURS) + "</fills>"
#: Cell formats: plain, banner, title, provenance, header, footer, restricted row, unknown row.
_FORMATS = [(0, 0), (1, 0), (2, 0), (3, 0), (4, 2), (5, 0), (0, 3), (0, 4)]


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx_bytes(rows: DataFrame, title: str, most: int = 100_000, meta: dict | None = None, order: list[str] | None = None) -> bytes:
    """One workbook of all rows, on the driver, for a bounded document: more than `most` rows are refused. `workbooks` makes many in tasks."""
    held = (rows.orderBy(*order) if order else rows).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} rows: write CSV or workbooks instead")
    return workbook(rows.columns, [r.asDict() for r in held], title, meta)


def workbooks(rows: DataFrame, order: str, title: str, rows_each: int = 1000, meta: dict | None = None) -> DataFrame:
    """chunk, name, content: the rows as workbooks of at most rows_each rows, made in tasks. Rows are dealt by the order column's
    number, an integer, and lie by it inside a workbook; the column itself is not part of it."""
    columns = [c for c in rows.columns if c != order]

    def make(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        chunk = int(pdf["sheet_chunk"].iloc[0])
        plain = pdf[columns].astype(object).where(pdf[columns].notna(), None)
        return pd.DataFrame([(chunk, f"{title}-{chunk}.xlsx", workbook(columns, plain.to_dict("records"), title, meta))], columns=["chunk", "name", "content"])

    return rows.withColumn("sheet_chunk", F.floor(F.col(order) / rows_each).cast("long")).groupBy("sheet_chunk").applyInPandas(make, "chunk long, name string, content binary")


def workbook(columns: list[str], held: list[dict], title: str, meta: dict | None = None) -> bytes:
    """A workbook with a title row, the header and the rows; with meta (generated_at, generated_by, db_revision) a report: banner,
    title, provenance line, header with a filter, the rows (filled by result or origin) and the digest of the body."""
    import datetime
    import hashlib

    report, meta = meta is not None, {"generated_at": "", "generated_by": "", "db_revision": ""} | (meta or {})
    digest = hashlib.sha256()
    for r in held:
        digest.update("|".join(f"{k}={r[k]}" for k in sorted(columns)).encode())

    def plain(v):
        if isinstance(v, datetime.datetime) and v.tzinfo is not None:
            v = v.astimezone(datetime.UTC).replace(tzinfo=None)
        return "" if v is None else v

    lines = [([R.SHEET_BANNER], 1), ([title], 2), ([R.SHEET_PROVENANCE % (meta["generated_at"], meta["generated_by"], meta["db_revision"], len(held))], 3), ([], 0), ([c.replace("_", " ").upper() for c in columns], 4)]
    lines = lines if report else [([title], 2), (columns, 0)]
    head = len(lines)
    for r in held:
        verdict = next((r[c] for c in ("result", "is_chinese") if r.get(c)), "")
        lines.append(([plain(r[c]) for c in columns], {"chinese": 6, "YES": 6, "unknown_origin": 7, "UNKNOWN": 7}.get(verdict, 0)))
    if report:
        lines += [([], 0), ([R.SHEET_FOOTER % digest.hexdigest()], 5)]

    def cell(v, style: int) -> str:
        if isinstance(v, bool) or not isinstance(v, int | float):
            return f'<c t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        return f'<c s="{style}"><v>{v}</v></c>'

    ns = "http://schemas.openxmlformats.org/"
    sheet = "".join(f"<row>{''.join(cell(v, style) for v in values)}</row>" for values, style in lines)
    wide = ("remarks", "component_name", "alternative_manufacturer")
    cols = "".join(f'<col min="{i}" max="{i}" width="{50 if c in wide else 18}" customWidth="1"/>' for i, c in enumerate(columns, 1))
    formats = "".join(f'<xf fontId="{font}" fillId="{fill}" applyFont="1" applyFill="1"/>' for font, fill in _FORMATS)
    styles = f'<styleSheet xmlns="{ns}spreadsheetml/2006/main">{_FONTS}{_FILLS}<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(_FORMATS)}">{formats}</cellXfs></styleSheet>'
    view = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{head}" topLeftCell="A{head + 1}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{ns}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}styles+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{ns}package/2006/relationships"><Relationship Id="r1" Type="{ns}officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}spreadsheetml/2006/main" xmlns:r="{ns}officeDocument/2006/relationships"><sheets><sheet name="{escape(title[:31] or "REPORT")}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{ns}package/2006/relationships"><Relationship Id="r1" Type="{ns}officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{ns}officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}spreadsheetml/2006/main">{view}<cols>{cols}</cols><sheetData>{sheet}</sheetData><autoFilter ref="A{head}:{_letters(len(columns))}{head + len(held)}"/></worksheet>')
    return out.getvalue()


def save_version(catalogue: DataFrame, root: str, version: int, source: str = "server") -> str:
    """A snapshot beside the earlier ones, sorted by key inside its files so that lookups prune; restoring is reading an earlier one.
    It is listed in the manifest once it is written, so a snapshot that failed halfway is never taken."""
    path = f"{root}/version={version}"
    catalogue.repartitionByRange("search_key").sortWithinPartitions("search_key").write.mode("errorifexists").parquet(path)
    listed = catalogue.sparkSession.createDataFrame([(source, version, path)], _MANIFEST)
    listed.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/manifest")
    return path


_MANIFEST = "source string, version int, path string"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """source, version, path, saved_at of the snapshots that are whole."""
    return spark.read.schema(f"{_MANIFEST}, saved_at timestamp").parquet(f"{root}/manifest")


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def restore_version(spark: SparkSession, root: str, current: DataFrame, version: int, copy: int) -> DataFrame:
    """An earlier version, after the current rows were saved as version `copy`, so that a restore can be undone like any other."""
    save_version(current, root, copy)
    return read_version(spark, root, version)


def write_seed(catalogue: DataFrame, root: str, rows_each: int = 1000) -> dict[str, str]:
    """The seed as CSV, JSON documents, Parquet and a summary; the places of each."""
    places = {k: f"{root}/{k}" for k in ("csv", "json", "parquet", "summary")}
    rows = catalogue.drop("ord", "is_deleted", "pending_verification")
    write_csv(rows, places["csv"])
    write_documents(json_documents(catalogue.drop("is_deleted", "pending_verification"), "ord", "", 1, rows_each), places["json"])
    rows.write.parquet(places["parquet"])
    seed_summary(catalogue).write.parquet(places["summary"])
    return places
