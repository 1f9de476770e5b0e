"""WARC archives: a writer with payload deduplication, and a reader that salvages what damaged archives still hold.

The writer is plain DataFrame work: a record is one string, and the text sink with the record terminator as line separator
makes each part file an archive, in whatever store Spark writes to. The reader takes whole archive files, parses them, and
after a failed check looks for the next gzip member or version line, goes on there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, flag_listed, scratch, table

DIGEST_FROM = 1000  # payload bytes from which equal payloads are stored once
RECORDS_A_FILE, LARGE_PAYLOAD, FILE_BYTES = 2000, 1 << 18, 1 << 29  # a file has so many records below LARGE_PAYLOAD, and larger ones up to FILE_BYTES (or one record)
EOL = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CAPTURE_DATE = "2024-01-01T00:00:00Z"


def deduplicated(pages: DataFrame, least: int = DIGEST_FROM) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_bytes, payload_digest and refers_to (null: a response).

    Of equal payloads of at least `least` bytes the one with the largest page_id is stored, the others refer to it. Rows that
    repeat that page_id are responses too; where all page_ids of a group are null, each is a response. A null html is ''.

    Only digests that occur twice are joined back, one row each, and only to the rows that may have one of them: a bitmap of
    fixed size lets the others pass without being shuffled. The pages' side of the join is the only one with a hot key, so AQE
    can split it.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    long_ = rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("head_digest"))
    heads = long_.agg(F.max("page_id").alias("head_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and head_id is not null").select("head_digest", "head_id", F.xxhash64("head_digest").alias("head_key"))
    heads = cut(heads, "warc-heads")
    told = flag_listed(rows.withColumn("key", F.xxhash64("payload_digest")), "key", heads, "head_key", "listed").drop("key")
    joined = told.where("listed").join(heads.drop("head_key"), (F.col("payload_digest") == F.col("head_digest")) & (F.col("payload_bytes") >= least), "left")
    joined = joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("head_id")), F.col("head_id")))
    columns = [*rows.columns, "refers_to"]
    return told.where("not listed").withColumn("refers_to", F.lit(None).cast(joined.schema["refers_to"].dataType)).select(columns).unionByName(joined.select(columns))


def record_text(row_id: Column, url: Column, payload: Column, payload_bytes: Column, digest: Column, refers_to: Column) -> Column:
    """A record without its terminator. A revisit has only the HTTP head as block."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    first = refers_to.isNull()
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1" + EOL),
        line("WARC-Type", F.when(first, "response").otherwise("revisit")),
        line("WARC-Record-ID", named(row_id)),
        line("WARC-Date", F.lit(CAPTURE_DATE)),
        F.when(url.isNotNull(), line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", "%0A"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("X-Payload-Length", payload_bytes.cast("string")),
        F.when(first, "").otherwise(F.concat(line("WARC-Refers-To", named(refers_to)), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.lit(len(HTTP_HEAD)) + F.when(first, payload_bytes).otherwise(0)).cast("string")),
        F.lit(EOL + HTTP_HEAD),
        F.when(first, payload).otherwise(""),
    )


def write_warc(pages: DataFrame, path: str | None = None, least: int = DIGEST_FROM, gzipped: bool = False, damage=None) -> str:
    """Archives of the pages' records. damage (a function of the record's text and page_id, for tests of the reader) may spoil
    records on their way. Large payloads go into files of their own, so many a file that none passes FILE_BYTES."""
    path = path or scratch(pages.sparkSession, "warc")
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    d = deduplicated(pages, least)
    text = record_text(d["page_id"], d["url"], d["payload"], d["payload_bytes"], d["payload_digest"], d["refers_to"])
    text = damage(text, d["page_id"]) if damage else text
    records = d.select(text.alias("value"), "payload_bytes")

    def write(rows: DataFrame, each: int) -> None:
        rows.select("value").write.mode("append").option("lineSep", EOL * 2).option("maxRecordsPerFile", each).option("compression", "gzip" if gzipped else "none").text(path)

    if largest < LARGE_PAYLOAD:
        write(records, RECORDS_A_FILE)
    else:
        write(records.where(F.col("payload_bytes") < LARGE_PAYLOAD), RECORDS_A_FILE)
        write(records.where(F.col("payload_bytes") >= LARGE_PAYLOAD), max(1, min(RECORDS_A_FILE, FILE_BYTES // (largest + 4096))))
    return path


class Damaged(ValueError):
    pass


VERSION = re.compile(rb"WARC/\d\.\d\r\n")
MEMBER = b"\x1f\x8b\x08"
CHUNK = 1 << 16


class Finder:
    """Where the next of some byte strings is; each stretch of the data is searched once for each, however often it is asked."""

    def __init__(self, data: bytes):
        self.data, self.known = data, {}

    def __call__(self, what: bytes, at: int) -> int:
        """The first place of `what` from `at` on, or -1; `at` never falls between calls."""
        place = self.known.get(what)
        if place is None or 0 <= place < at:
            place = self.known[what] = self.data.find(what, at)
        return place

    def version(self, at: int) -> int:
        place = self.known.get(VERSION)
        if place is None or 0 <= place < at:
            found = VERSION.search(self.data, at)
            place = self.known[VERSION] = found.start() if found else -1
        return place


def parse_record(data: bytes, at: int) -> tuple[dict, int, int, int]:
    """Headers (lower-case names), block start, block end and end of the record that starts at `at`; Damaged if a check fails.

    The header is read line by line, so what looks like one costs no more than its good lines."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    fields, line = {}, version.end()
    while True:
        stop = data.find(b"\r\n", line)
        if stop < 0:
            raise Damaged("header not ended")
        if stop == line:
            break
        name, colon, value = data[line:stop].partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        line = stop + 2
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Damaged("no content length")
    start, end = line + 2, line + 2 + int(size)
    if len(data) < end + 4:
        raise Damaged("block cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no record end where the length says")
    return fields, start, end, end + 4


def checked(fields: dict, block: bytes) -> bytes:
    """The payload (after the HTTP head, if it is an HTTP record); Damaged if it hasn't the digest that the header says."""
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        cut_at = block.find(b"\r\n\r\n")
        payload = block[cut_at + 4 :] if cut_at >= 0 else b""
    algorithm, _, said = fields.get("warc-payload-digest", "").partition(":")
    if said and algorithm == "sha1" and fields.get("warc-type") != "revisit" and hashlib.sha1(payload).hexdigest() != said.lower():
        raise Damaged("payload digest differs")
    return payload


def _unzip(data: bytes, at: int) -> tuple[bytes, int]:
    """A gzip member's content and its end; it is fed in chunks, so members after it are not copied."""
    opened, view, out, stop = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not opened.eof:
            if stop >= len(data):
                raise Damaged("gzip member cut off")
            out.append(opened.decompress(view[stop : stop + CHUNK]))
            stop += CHUNK
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    return b"".join(out), min(stop, len(data)) - len(opened.unused_data)


def salvage(data: bytes, zipped: bool = True) -> Iterator[tuple]:
    """('record', offset, end, headers, payload) for what passes its checks and ('gap', offset, end, reason) for the bytes
    between, in order and without overlap. Offsets of records inside a gzip member are those of the member; a member is
    inflated whole, and one inside another is no member. Time is linear in the data but for false starts that look whole."""
    at, gap, reason, find = 0, None, "", Finder(data)
    while at < len(data):
        try:
            if zipped and data[at : at + 3] == MEMBER:
                inner, end = _unzip(data, at)
                found = list(salvage(inner, False))
                if not any(x[0] == "record" for x in found):
                    raise Damaged("no record in the gzip member")
                if gap is not None:
                    yield "gap", gap, at, reason
                    gap = None
                for x in found:
                    yield (x[0], at, end, *x[3:])
                at = end
                continue
            fields, start, block_end, end = parse_record(data, at)
            payload = checked(fields, data[start:block_end])
        except Damaged as why:
            if gap is None:
                gap, reason = at, str(why)
            places = [find.version(at + 1), *([find(MEMBER, at + 1)] if zipped else [])]
            at = min((p for p in places if p >= 0), default=len(data))
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        yield "record", at, end, fields, payload
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason


READ_SCHEMA = "kind string, archive string, start long, stop long, reason string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"
_ARROW = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in READ_SCHEMA.split(", ")])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record (kind record) or quarantined gap (kind gap) of all archive files under path.

    A file is read whole by one task and may have 2 GB at most; write_warc's have a quarter of that. Digest and length are
    those of the full payload: a revisit's come from its header, and where that has no length it is null.
    """

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for x in salvage(content.as_py()):
                    if x[0] == "gap":
                        rows.append(("gap", name, x[1], x[2], x[3], *[None] * 7))
                    else:
                        _, start, stop, h, payload = x
                        revisit = h.get("warc-type") == "revisit"
                        digest = h.get("warc-payload-digest", "").rpartition(":")[2] or hashlib.sha1(payload).hexdigest()
                        said = h.get("x-payload-length", "")  # our own writer's; other archives' revisits don't tell
                        length = len(payload) if not revisit else int(said) if said.isascii() and said.isdigit() else None
                        held += len(payload) * payloads
                        rows.append(("record", name, start, stop, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, length, payload if payloads else None))
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")
    return files.mapInArrow(parse, READ_SCHEMA)


def _page(c: str) -> Column:
    return F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def op8_warc_round_trip(spark, sf_dir):
    """Writes all pages as WARC archives and reads them back.

    A null html is an empty payload, a null url leaves its header out, a null page_id comes back null; repeated pages are
    records of their own, and no pages give no rows."""
    path = write_warc(table(spark, sf_dir, "pages"))
    back = read_warc(spark, path, payloads=False).where("kind = 'record'")
    return back.select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to"))


def _spoilt(text: Column, page_id: Column) -> Column:
    """Every seventh page's record damaged: in turn its version line, its length, and the digest that its payload should have."""
    kind = F.pmod(page_id, F.lit(21))
    return (
        F.when(kind == 0, F.regexp_replace(text, "^WARC/1.1", "WARX/1.1"))
        .when(kind == 7, F.regexp_replace(text, r"\nContent-Length: ", "\nContent-Length: 9"))
        .when(kind == 14, F.regexp_replace(text, r"sha1:[0-9a-f]{4}", "sha1:zzzz"))
        .otherwise(text)
    )


def warc_salvage(spark, sf_dir):
    """All pages as archives, half of them gzipped, with every seventh record damaged by rule: which pages the reader recovers."""
    pages = table(spark, sf_dir, "pages").where("page_id is not null")
    halves = [write_warc(pages.where(F.pmod("page_id", F.lit(2)) == i), least=1 << 62, gzipped=bool(i), damage=_spoilt) for i in (0, 1)]
    found = read_warc(spark, halves[0], payloads=False).unionByName(read_warc(spark, halves[1], payloads=False))
    back = found.where("kind = 'record'").groupBy(_page("record_id").alias("page_id")).agg(F.max("payload_digest").alias("payload_digest"))
    return pages.select("page_id").join(back, "page_id", "left").select("page_id", F.col("payload_digest").isNotNull().alias("recovered"), "payload_digest")


SALVAGE_SQL = "SELECT page_id, page_id % 7 <> 0 AS recovered, CASE WHEN page_id % 7 <> 0 THEN sha1(coalesce(html, '')) END AS payload_digest FROM pages WHERE page_id IS NOT NULL"
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
h AS (SELECT html, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN h.head <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN h.head <> p.page_id THEN h.head END AS refers_to
FROM p LEFT JOIN h ON p.html = h.html AND p.n >= 1000
"""
