"""The catalogue: search, facets, counters, edits and change feeds. Every write makes a new version; none changes data in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.origin import derive_origin
from ..rules import tables as R
from ..session import cut

SEARCHED = ["component_name", "part_number", "chip_number", "manufacturer", "remarks", "barcode", "supplier"]
SEARCHED_OFFLINE = ["component_name", "part_number", "chip_number", "manufacturer", "remarks", "drone_subsystem", "supplier"]
FACETS = ["country_of_origin", "manufacturer", "drone_subsystem", "category", "criticality"]


def live(catalogue: DataFrame) -> DataFrame:
    return catalogue.where(~F.col("is_deleted"))


def search(catalogue: DataFrame, query: str = "", *, fields: list[str] | None = None, pending: bool | None = None, **equal: str) -> DataFrame:
    """Live rows that hold the query in one of the fields (in any case; % and _ are wildcards) or whose key begins with it, and
    that equal every facet given."""
    out = live(catalogue)
    if query.strip():
        like = f"%{query.strip()}%"
        spark = catalogue.sparkSession
        key = spark.range(1).select(X.normalize(F.lit(query))).first()[0]
        tests = [F.coalesce(F.col(c), F.lit("")).ilike(like) for c in fields or SEARCHED]
        out = out.where(reduce(lambda a, b: a | b, tests + ([F.col("search_key").startswith(key)] if key else [])))
    for column, value in equal.items():
        if value:
            out = out.where(F.col(column) == value)
    return out if pending is None else out.where(F.col("pending_verification") == pending)


INDEX_BUCKETS = 64
GRAM = 5


def _pieces(c: Column) -> Column:
    """The parts of a search text between wildcards, in lower case."""
    return F.filter(F.split(F.lower(X.strip(c)), "[%_]"), lambda p: p != "")


def _grams_of(text: Column) -> Column:
    """Distinct substrings of GRAM characters, and the shorter ones that the text ends with: any part of the text is one of them
    or begins one, or has one, as it is shorter than GRAM or not."""
    return F.when(F.length(text) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _probes_of(piece: Column) -> Column:
    """What a piece is looked up by: its substrings of GRAM characters, or all of it if it is shorter, as the beginning of grams."""
    return F.filter(_grams_of(piece), lambda g: F.length(g) == F.least(F.length(piece), F.lit(GRAM)))


def _gram_bucket(gram: str = "gram") -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(INDEX_BUCKETS)).cast("int")


def write_search_index(catalogue: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """Postings of the live rows' searched fields: gram, component_id, by the gram's bucket and sorted by gram, so that a search
    reads its grams' buckets and of these the row groups that may hold them."""
    texts = F.array_distinct(F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in fields or SEARCHED]))
    grams = F.flatten(F.transform(texts, _grams_of))
    postings = live(catalogue).select("component_id", F.explode(F.array_distinct(grams)).alias("gram")).withColumn("gram_bucket", _gram_bucket())
    postings.repartition("gram_bucket").sortWithinPartitions("gram_bucket", "gram").write.partitionBy("gram_bucket").parquet(path)


def search_many(catalogue: DataFrame, index: str, queries: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """query, component_id: what `search` finds for each of the queries (query), through the postings of `write_search_index`.

    A query meets the rows of its rarest probe, and these alone are tested for the whole query. A probe has GRAM characters, or is
    a shorter piece as a whole and is met by every gram that begins with it; so a query of GRAM characters or fewer meets the
    rows that have it and no others, however many rows and queries there are. Rows whose key begins with a query are met by
    prefixes, of asked lengths. A query of wildcards only, or of nothing, names every row and finds none here: that is `search`'s.
    """
    spark = catalogue.sparkSession
    asked = queries.select("query").distinct().withColumn("pieces", _pieces(F.col("query"))).where(F.size("pieces") > 0)
    asked = cut(asked.select("query", F.explode(F.array_distinct(F.flatten(F.transform("pieces", _probes_of)))).alias("probe")), "search-asked")
    postings = spark.read.schema("gram string, component_id string, gram_bucket int").parquet(index)
    counts = cut(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "search-counts")
    begins = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda i: F.substring("gram", F.lit(1), i)))).alias("probe")
    met = cut(counts.select("gram", "n", begins).join(asked.select("probe").distinct(), "probe"), "search-grams")
    sizes = met.groupBy("probe").agg(F.sum("n").alias("n"))
    rarest = asked.join(sizes, "probe", "left").groupBy("query").agg(F.min_by("probe", F.struct(F.coalesce("n", F.lit(0)), F.col("probe"))).alias("probe"))
    chosen = cut(rarest.join(met, "probe").select("query", "gram"), "search-chosen")
    buckets = [r[0] for r in chosen.select(_gram_bucket()).distinct().collect()]  # INDEX_BUCKETS at most
    texts = live(catalogue).select("component_id", *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in fields or SEARCHED])
    found = chosen.join(postings.where(F.col("gram_bucket").isin(buckets)), "gram").select("query", "component_id").join(texts, "component_id")
    text = F.lower(X.strip(F.col("query")))
    any_field = lambda test: reduce(lambda a, b: a | b, [test(F.col(c)) for c in fields or SEARCHED])
    pattern = F.concat(F.lit("%"), text, F.lit("%"))
    found = found.where(F.when(text.rlike(r"[%_\\]"), any_field(lambda c: F.like(c, pattern))).otherwise(any_field(lambda c: c.contains(text)))).select("query", "component_id")
    keyed = asked.select("query").distinct().withColumn("key", X.normalize(F.col("query"))).where("key <> ''")
    lengths = [r[0] for r in keyed.select(F.length("key")).distinct().collect()]  # few, whatever the queries
    known = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    begun = live(catalogue).select("component_id", F.explode(F.transform(F.filter(known, lambda n: n <= F.length("search_key")), lambda n: F.substring("search_key", F.lit(1), n))).alias("key"))
    return found.unionByName(keyed.join(begun, "key").select("query", "component_id")).distinct()


def page(rows: DataFrame, number: int = 1, size: int = 50, order: str = "component_name") -> DataFrame:
    return rows.orderBy(order, "component_id").offset((max(number, 1) - 1) * size).limit(size)


def page_with_total(rows: DataFrame, number: int = 1, size: int = 50, order: str = "component_name") -> DataFrame:
    """A page whose rows also tell how many rows there are in all; the driver sees that number alone."""
    return page(rows, number, size, order).withColumn("total", F.lit(rows.count()).cast("long"))


def named(catalogue: DataFrame, ids: DataFrame) -> DataFrame:
    """The live rows of the ids asked for (component_id), each once."""
    return live(catalogue).join(ids.select("component_id").distinct(), "component_id", "left_semi")


def facets(catalogue: DataFrame) -> DataFrame:
    """facet, value, n over the live rows, in one pass; blanks are (blank)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(blank)")).alias("value")) for c in FACETS]))
    return live(catalogue).select(pairs.alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))



def counters(catalogue: DataFrame) -> DataFrame:
    """One row of six counts over the live catalogue."""
    yes = F.col("is_chinese") == "YES"
    return live(catalogue).agg(
        F.count(F.lit(1)).alias("total_components"), F.count_if(yes).alias("chinese_components"), F.count_if(F.col("is_chinese") == "NO").alias("non_chinese_components"),
        F.count_if(F.col("is_chinese") == "UNKNOWN").alias("unknown_origin"), F.count_if("pending_verification").alias("pending_verification"), F.count_if(yes & (F.col("criticality") == "CRITICAL")).alias("critical_chinese"),
    )


def seed_summary(catalogue: DataFrame) -> DataFrame:
    flag = lambda v: F.count_if(F.col("is_chinese") == v)
    critical = F.col("criticality") == "CRITICAL"
    return catalogue.agg(F.count(F.lit(1)).alias("total"), flag("YES").alias("yes"), flag("NO").alias("no"), flag("UNKNOWN").alias("unknown"), F.count_if(critical).alias("critical"), F.count_if(critical & (F.col("is_chinese") == "YES")).alias("critical_yes"))


def by_subsystem(catalogue: DataFrame) -> DataFrame:
    return live(catalogue).where("is_chinese = 'YES'").groupBy("drone_subsystem").agg(F.count(F.lit(1)).alias("n"))


def distinct_values(catalogue: DataFrame, field: str) -> DataFrame:
    return live(catalogue).select(F.col(field).alias("value")).where("value <> ''").distinct()


def changed_since(catalogue: DataFrame, since: Column, column: str = "updated_at") -> DataFrame:
    """Change feed: rows changed after a time, with op upsert or delete."""
    return catalogue.where(F.col(column) > since).withColumn("op", F.when(F.col("is_deleted"), "delete").otherwise("upsert"))


def bulk_update(catalogue: DataFrame, ids: DataFrame, **changes) -> DataFrame:
    """A version with the fields set on the rows named in ids (component_id), and their revision raised. Identity and origin
    fields are refused: each of their changes has to be made by itself."""
    if bad := sorted(set(changes) - set(R.BULK_FIELDS)):
        raise ValueError(f"not allowed in a bulk update: {', '.join(bad)}")
    marked = catalogue.join(ids.select("component_id").distinct().withColumn("named", F.lit(True)), "component_id", "left")
    hit = F.coalesce("named", F.lit(False))
    out = marked.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})
    if "revision" in catalogue.columns:
        out = out.withColumn("revision", F.col("revision") + hit.cast("int"))
    return out.select(catalogue.columns)


def soft_delete(catalogue: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("component_id").distinct().withColumn("gone", F.lit(True))
    return catalogue.join(gone, "component_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("gone", F.lit(False))).select(catalogue.columns)


def create(catalogue: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next version, outcomes). rows have component_id ('' or null: made from the part), the text fields and row_number. Origin,
    maker and key are derived, never taken as they are. An id that a live row has is refused; so is one that an earlier of the
    rows takes. outcomes: row_number, component_id, outcome (created, conflict) and after, the post-image of a created row.
    A created id that only a deleted row has replaces that row.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    made = rows.withColumns({
        "manufacturer": X.manufacturer_key(given("manufacturer")),
        "is_chinese": derive_origin(given("country_of_origin"), given("remarks"), F.lit("")),
        "search_key": X.normalize(F.coalesce(F.nullif(given("chip_number"), F.lit("")), given("part_number"))),
    })
    own = X.component_id(given("chip_number"), given("part_number"), given("component_name"), F.col("manufacturer"))
    made = made.withColumn("component_id", F.coalesce(F.nullif(given("component_id"), F.lit("")), own))
    made = made.withColumns({"pending_verification": F.col("is_chinese") == "UNKNOWN", "revision": F.lit(1), "is_deleted": F.lit(False)})
    first = made.groupBy("component_id").agg(F.min("row_number").alias("first"))
    taken = live(catalogue).select("component_id").withColumn("taken", F.lit(True))
    judged = made.join(first, "component_id").join(taken, "component_id", "left")
    refused = F.coalesce("taken", F.lit(False)) | (F.col("row_number") > F.col("first"))
    image = F.struct(*[(F.col(c).cast(t) if c in judged.columns else F.lit(None).cast(t)).alias(c) for c, t in catalogue.dtypes])
    outcomes = judged.select("row_number", "component_id", F.when(refused, "conflict").otherwise("created").alias("outcome"), F.when(~refused, image).alias("after"))
    fresh = outcomes.where("outcome = 'created'").select("after.*")
    kept = catalogue.join(fresh.select("component_id"), "component_id", "left_anti").select(catalogue.columns)
    return kept.unionByName(fresh), outcomes


def edit(catalogue: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next version, pre-images). edits: component_id and the fields to set, one row an id; a null field is left as it is.

    A new country derives the origin again (the declared flag has no say) and sets pending by it; a new maker is brought to its
    key; the revision is raised. Ids that no live row has change nothing."""
    fields = [c for c in edits.columns if c != "component_id"]
    if bad := sorted(set(fields) - set(catalogue.columns)):
        raise ValueError(f"no such fields: {', '.join(bad)}")
    asked = edits.select("component_id", F.struct(*fields).alias("edit"))
    joined = catalogue.join(asked, "component_id", "left").withColumn("hit", F.col("edit").isNotNull() & ~F.col("is_deleted"))
    before = joined.where("hit").select("component_id", F.struct(*catalogue.columns).alias("before"))
    new = {c: F.when(F.col("hit"), F.coalesce(F.col(f"edit.{c}"), F.col(c))).otherwise(F.col(c)) for c in fields}
    if "manufacturer" in new:
        new["manufacturer"] = F.when(F.col("hit") & F.col("edit.manufacturer").isNotNull(), X.manufacturer_key(F.col("edit.manufacturer"))).otherwise(F.col("manufacturer"))
    moved = F.col("hit") & F.col("edit.country_of_origin").isNotNull() if "country_of_origin" in fields else F.lit(False)
    out = joined.withColumn("moved", moved).withColumns(new)
    flag = derive_origin(F.col("country_of_origin"), F.col("remarks"), F.lit(""))
    out = out.withColumns({"is_chinese": F.when(F.col("moved"), flag).otherwise(F.col("is_chinese"))})
    out = out.withColumn("pending_verification", F.when(F.col("moved"), F.col("is_chinese") == "UNKNOWN").otherwise(F.col("pending_verification")))
    if "revision" in catalogue.columns:
        out = out.withColumn("revision", F.col("revision") + F.col("hit").cast("int"))
    return out.select(catalogue.columns), before


def edit_country(catalogue: DataFrame, component_id: str, country: str) -> DataFrame:
    """A version with one row's country changed."""
    one = catalogue.sparkSession.createDataFrame([(component_id, country)], "component_id string, country_of_origin string")
    return edit(catalogue, one)[0]


def seed(catalogue: DataFrame, rows: DataFrame) -> DataFrame:
    """The catalogue with those seed rows whose ids it has not, live or deleted; derived like created ones, but a declared
    origin counts. Of rows with one id the first is taken, by row_number where the rows have it (as files read by readers do),
    else by the whole row."""
    derived = rows.withColumns({
        "is_chinese": derive_origin(F.col("country_of_origin"), F.col("remarks"), F.col("is_chinese")),
        "manufacturer": X.manufacturer_key(F.col("manufacturer")),
        "search_key": X.normalize(F.coalesce(F.nullif("chip_number", F.lit("")), "part_number")),
    }).withColumn("pending_verification", F.col("is_chinese") == "UNKNOWN")
    place = F.col("row_number") if "row_number" in rows.columns else F.struct(*sorted(rows.columns))
    first = derived.withColumn("seed_place", place).groupBy("component_id").agg(F.min_by(F.struct(*[c for c in derived.columns if c != "component_id"]), "seed_place").alias("r")).select("component_id", "r.*")
    fresh = first.join(catalogue.select("component_id"), "component_id", "left_anti")
    return catalogue.unionByName(fresh.select(*[c for c in catalogue.columns if c in fresh.columns]), allowMissingColumns=True)


def history(revisions: DataFrame, newest_first: str = "created_at") -> DataFrame:
    """revisions with place: 1 for the newest of each component."""
    order = Window.partitionBy("component_id").orderBy(F.desc(newest_first), F.desc("batch_id"))
    return revisions.withColumn("place", F.row_number().over(order))


def latest(rows: DataFrame, at: str, tie: str, n: int = 50) -> DataFrame:
    """The n newest rows: import batches, log entries."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(n)


def reclassify_unknown(catalogue: DataFrame) -> DataFrame:
    """Rows flagged NO whose country says it is not known become UNKNOWN and pending."""
    wrong = (F.col("is_chinese") == "NO") & F.upper(F.trim("country_of_origin")).isin(R.UNKNOWN_AT_IMPORT)
    return catalogue.withColumns({"is_chinese": F.when(wrong, "UNKNOWN").otherwise(F.col("is_chinese")), "pending_verification": wrong | F.col("pending_verification")})


def merge_catalogues(old: DataFrame, new: DataFrame, keep: tuple[str, ...] = ("date_added",)) -> DataFrame:
    """Offline merge: a new row's non-empty values overwrite the old row's, except kept fields; other rows of both stay."""
    a, b = old.alias("a"), new.alias("b")
    fields = [c for c in old.columns if c != "component_id"]
    def pick(c: str) -> Column:
        fresh = F.nullif(F.col(f"b.{c}").cast("string"), F.lit("")).isNotNull()
        mine, theirs = F.col(f"a.{c}"), F.col(f"b.{c}")
        return (F.coalesce(mine, theirs) if c in keep else F.when(fresh, theirs).otherwise(F.coalesce(mine, theirs))).alias(c)
    return a.join(b, F.col("a.component_id") == F.col("b.component_id"), "full").select(F.coalesce("a.component_id", "b.component_id").alias("component_id"), *[pick(c) for c in fields])


def enrich(rows: DataFrame) -> DataFrame:
    """Seed rows with subsystem, policy, alternatives, canonical maker, synthetic codes and military grade filled in.

    The policy tables are fixed and small, so they are literal maps rather than joins."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    table = lambda pairs: F.create_map(*[F.lit(x) for p in pairs for x in p])
    level, policy, note = (table([(p[0], p[i]) for p in R.POLICY]) for i in (1, 2, 3))
    alts = table([(k, "; ".join(v)) for k, v in R.ALTERNATIVES.items()])
    out = rows.withColumn("drone_subsystem", F.when(blank("drone_subsystem"), X.subsystem_of(F.col("component_name"))).otherwise(F.col("drone_subsystem")))
    sub = F.col("drone_subsystem")
    found = F.try_element_at(level, sub)
    out = out.withColumns({
        "criticality_policy": F.coalesce(F.try_element_at(policy, sub), F.nullif("criticality_policy", F.lit("")), F.lit(R.UNCLASSIFIED_POLICY)),
        "criticality": F.coalesce(found, F.nullif("criticality", F.lit("")), F.lit("REVIEW")),
        "remarks": F.when(blank("remarks"), F.coalesce(F.try_element_at(note, sub), F.lit(""))).otherwise(F.col("remarks")),
        "alternative_manufacturer": F.when(blank("alternative_manufacturer"), F.coalesce(F.try_element_at(alts, sub), F.try_element_at(alts, F.col("category")), F.lit(""))).otherwise(F.col("alternative_manufacturer")),
        "manufacturer": X.manufacturer_key(F.col("manufacturer"), suffixes=False),
        "barcode": F.when(blank("barcode"), X.synthetic_barcode(F.col("component_id"))).otherwise(F.col("barcode")),
        "qr_code": F.when(blank("qr_code"), X.qr_payload(F.col("component_id"), F.col("chip_number"), F.col("part_number"))).otherwise(F.col("qr_code")),
    })
    return out.withColumn("military_grade", F.when(F.col("criticality") == "CRITICAL", "YES").otherwise(F.col("military_grade")))


def union_with_precedence(branches: list[DataFrame]) -> DataFrame:
    """Rows of all branches, one an id: the first, unless its origin is unknown; then the first whose origin is known, if any."""
    out = None
    for i, branch in enumerate(branches):
        tagged = branch.withColumn("branch", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    fields = branches[0].columns
    known = ~F.coalesce(F.col("is_chinese"), F.lit("")).isin("UNKNOWN", "")
    best = F.min_by(F.struct(*fields), F.struct((~known).alias("u"), "branch", "row_number"))
    return out.groupBy("component_id").agg(best.alias("r")).select("r.*")
