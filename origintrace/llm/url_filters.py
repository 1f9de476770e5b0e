"""Temporal list join: every capture against the URL-list entries that were active when it was fetched. DataFrame operations only.

A list is a log of dated entries (entry, listed_at, action add or remove, category). Each key's entries become validity
intervals that do not overlap, and an as-of join on (key, time) finds the one that held at fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

def host_of(url: Column) -> Column:
    """Lower-case host without user, port and last dot; '' where the text is no URL with an authority."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def lookup_keys(url: Column, longest: int) -> Column:
    """Array of what entries of at most `longest` characters may name: the host, each parent domain, the host with its path.

    Longer ones can't equal an entry, so only the host's last characters are split: a URL of any length gives few keys."""
    host = host_of(url)
    end = F.right(host, F.lit(longest + 1))
    labels = F.split(end, r"\.")  # what follows any dot of the end is a parent domain
    parents = F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(host, F.concat(host, path_of(url))), parents)
    return F.array_distinct(F.filter(every, lambda k: (host != "") & (F.length(k) <= longest)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """entry, category, valid_from, valid_until (null: still listed). Of several entries for a key at one time a removal
    counts, else the greatest category. Entries without key or time are ignored."""
    one = entries.where("entry is not null and listed_at is not null").groupBy(F.lower("entry").alias("entry"), "listed_at").agg(F.max(F.struct("action", "category")).alias("last"))
    later = Window.partitionBy("entry").orderBy("listed_at")
    return one.withColumn("valid_until", F.lead("listed_at").over(later)).where("last.action = 'add'").select("entry", F.col("last.category").alias("category"), F.col("listed_at").alias("valid_from"), "valid_until")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row a capture (key, url, fetched_at), with host, blocked, matched, category, listed_from; other columns of the
    input, whatever their names, are left out.

    The longest matching key counts. Null or odd URLs and null times match nothing. Repeated rows come back as often. An empty
    list blocks nothing, and no captures give no rows.
    The list side has one row a key and interval and is broadcast only if Spark finds it under its threshold; else both
    sides are shuffled by key, where a host with a third of all captures is split by AQE (the list side holds it once).
    """
    captures = captures.groupBy("key", "url", "fetched_at").agg(F.count(F.lit(1)).alias("copies"))
    spans = validity_intervals(entries)
    longest = spans.agg(F.max(F.length("entry"))).first()[0] or 0
    hits = (
        captures.select("key", "url", "fetched_at", F.explode(lookup_keys(F.col("url"), longest)).alias("entry"))
        .join(spans, "entry")
        .where("fetched_at >= valid_from and (valid_until is null or fetched_at < valid_until)")
        .groupBy("key", "url", "fetched_at")
        .agg(F.max(F.struct(F.length("entry").alias("n"), "entry", "category", "valid_from")).alias("hit"))
    )
    a, b = captures.alias("a"), hits.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("key", "url", "fetched_at")]
    return (
        a.join(b, same, "left")
        .select("a.*", "b.hit")
        .select("key", "url", "fetched_at", host_of(F.col("url")).alias("host"), F.col("hit").isNotNull().alias("blocked"), F.col("hit.entry").alias("matched"), F.col("hit.category").alias("category"), F.col("hit.valid_from").alias("listed_from"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .drop("copy")
    )


HOURS = 8760

#: The production list, by rule from the pages' own hosts (h: host and its least page_id n) and addresses, in SQL that Spark and
#: other engines read alike. Times are hours after 2024-01-01. It has overlaps (a host and its parent domain), entries taken
#: off and put on again, two additions and an addition with a removal at one time, and single pages.
LIST_SQL = f"""
SELECT h.host AS entry, h.n * 37 % {HOURS} AS listed_at, 'add' AS action, 'scam' AS category FROM h WHERE h.n % 3 = 0
UNION ALL SELECT h.host, h.n * 37 % {HOURS}, 'add', 'spam' FROM h WHERE h.n % 6 = 0
UNION ALL SELECT h.host, h.n * 37 % {HOURS}, 'remove', NULL FROM h WHERE h.n % 15 = 0
UNION ALL SELECT h.host, h.n * 37 % {HOURS} + 1500, 'remove', NULL FROM h WHERE h.n % 9 = 0
UNION ALL SELECT h.host, h.n * 37 % {HOURS} + 3000, 'add', 'listed again' FROM h WHERE h.n % 9 = 0
UNION ALL SELECT d.domain, d.n * 11 % {HOURS}, 'add', 'network' FROM (SELECT domain, min(n) AS n FROM h WHERE domain <> '' GROUP BY domain) d WHERE d.n % 2 = 0
UNION ALL SELECT d.domain, d.n * 11 % {HOURS} + 800, 'remove', NULL FROM (SELECT domain, min(n) AS n FROM h WHERE domain <> '' GROUP BY domain) d WHERE d.n % 4 = 0
UNION ALL SELECT p.host || p.path, 0, 'add', 'page' FROM p WHERE p.host <> '' AND p.page_id % 40 = 7
UNION ALL SELECT p.host || p.path, 5000, 'remove', NULL FROM p WHERE p.host <> '' AND p.page_id % 80 = 7"""
DOMAIN = r"([^.]+\.[^.]+\.[^.]+)$"  # of three labels


def op9_url_list_asof(spark, sf_dir):
    """Every page, fetched (by this rule) 97 * page_id hours after 2024-01-01, round the year, against the dated list.

    Pages without an address or id match nothing; repeated pages come back as often; no pages give no rows."""
    pages = table(spark, sf_dir, "pages")
    host = host_of(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path_of(F.col("url")).alias("path"))
    h = p.where("host <> '' and page_id is not null").groupBy("host").agg(F.min("page_id").alias("n")).withColumn("domain", F.regexp_extract("host", DOMAIN, 1))
    log = spark.sql(LIST_SQL.replace(" FROM h", " FROM {h} h").replace(" FROM p", " FROM {p} p"), h=h, p=p)
    captures = pages.select(F.col("page_id").alias("key"), "url", F.pmod(F.col("page_id") * 97, F.lit(HOURS)).cast("long").alias("fetched_at"))
    return filter_captures(captures, log).select(F.col("key").alias("page_id"), "url", "host", F.col("fetched_at").alias("fetch_hour"), "blocked", "matched", "category", "listed_from")


OP9_SQL = f"""
WITH p AS (SELECT page_id, url, page_id * 97 % {HOURS} AS fetch_hour,
  regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\\.$', '') AS host,
  regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT host, min(page_id) AS n, regexp_extract(host, '{DOMAIN}', 1) AS domain FROM p WHERE host <> '' GROUP BY host),
log AS (SELECT lower(entry) AS entry, listed_at, max(struct_pack(a := action, c := coalesce(category, ''))) AS last FROM ({LIST_SQL}) GROUP BY ALL),
spans AS (SELECT * FROM (SELECT entry, last.c AS category, last.a AS action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY entry ORDER BY listed_at) AS valid_until FROM log) x WHERE action = 'add'),
parts AS (SELECT page_id, url, fetch_hour, unnest(list_distinct(list_concat([host || path], list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))))) AS entry FROM p WHERE host <> ''),
hits AS (SELECT q.page_id, q.url, s.entry, s.category, s.valid_from, row_number() OVER (PARTITION BY q.page_id, q.url ORDER BY length(s.entry) DESC) AS rn
  FROM parts q JOIN spans s ON q.entry = s.entry AND q.fetch_hour >= s.valid_from AND (s.valid_until IS NULL OR q.fetch_hour < s.valid_until))
SELECT p.page_id, p.url, p.host, p.fetch_hour, h.entry IS NOT NULL AS blocked, h.entry AS matched, h.category, CAST(h.valid_from AS BIGINT) AS listed_from
FROM p LEFT JOIN (SELECT * FROM hits WHERE rn = 1) h ON p.page_id = h.page_id AND p.url = h.url
"""
