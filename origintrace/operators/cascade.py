"""Record linkage: each scan's marking against the catalogue, by layers of exact, repaired, prefix and fuzzy joins.

What a key resolves to depends on the catalogue alone, so the catalogue is aggregated once to one row a key; a marking's probes
of all cheap layers are exploded with their layer and place, equi-joined, and the smallest (layer, place) wins. Only markings
without a hit go on to the prefix tables, and only those left to the fuzzy join. Joins whose smaller side grows with the input
merge: Spark sizes a few columns of a stored table, or what is generated from one, too low, and would broadcast millions of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..rules import tables as R
from ..session import cut
from . import bitmaps, fuzzy
from .ranking import ranked

CARRIED = ["component_id", "component_name", "manufacturer", "country_of_origin", "is_chinese", "category", "drone_subsystem", "criticality", "criticality_policy", "confidence_score", "verified_by", "verification_source", "search_key"]

BARCODE, QR, LABEL_BARCODE, LABEL_QR, KEY, LABEL_FIELD, CUT, GLYPH, FOLD, FOLD_CUT = range(1, 11)
METHODS = {BARCODE: "exact_code", QR: "exact_code", LABEL_BARCODE: "exact_code", LABEL_QR: "exact_code", KEY: "normalized", LABEL_FIELD: "label_mpn", CUT: "lot_code_stripped", GLYPH: "ocr_corrected", FOLD: "ocr_folded", FOLD_CUT: "ocr_folded_stripped"}


def _flag(c: str) -> Column:
    return F.upper(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("UNKNOWN")))


def resolved_keys(rows: DataFrame, by: str) -> DataFrame:
    """One row a value of `by`: what its catalogue rows agree on, by aggregates alone, whatever the rows of a key.

    Rows of unknown origin give way to others. One origin left: the row of the highest confidence (the first of equals).
    Several: a conflict, no component. begins is the key's first row; verdicts are the origins that its rows claim. The rows
    themselves are in `trail`.
    """
    base = rows.where(F.coalesce(F.col(by), F.lit("")) != "").withColumn("flag", _flag("is_chinese")).withColumn("definite", F.col("flag") != "UNKNOWN")
    best = F.max_by(F.struct(*CARRIED), F.struct("definite", F.coalesce("confidence_score", F.lit(0.0)), -F.col("ord")))
    return (
        base.groupBy(F.col(by).alias("probe"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("definite").alias("n_definite"), F.sort_array(F.collect_set(F.when(F.col("definite"), F.col("flag")))).alias("verdicts"), best.alias("component"), F.min("ord").alias("begins"))
        .withColumn("agreed", F.size("verdicts") <= 1)
        .withColumn("component", F.when(F.col("agreed"), F.col("component")))
        .select("probe", "agreed", "component", "n_rows", "n_definite", "verdicts", "begins")
    )


def lookups(catalogue: DataFrame) -> DataFrame:
    """kind (B, Q, K, F), probe, agreed, component, n_rows, n_definite, verdicts, begins: the catalogue as it is looked up."""
    live = catalogue.withColumn("fold", X.fold(F.col("search_key")))
    keys = [resolved_keys(live, by).select(F.lit(kind).alias("kind"), "*") for by, kind in (("search_key", "K"), ("fold", "F"))]

    def codes(column: str, kind: str) -> DataFrame:
        code = F.upper(X.strip(F.col(column)))
        last = live.where(code != "").groupBy(code.alias("probe")).agg(F.max_by(F.struct(*CARRIED), "ord").alias("component"), F.max("ord").alias("begins"))
        one = F.lit(1).cast("long")
        return last.select(F.lit(kind).alias("kind"), "probe", F.lit(True).alias("agreed"), "component", one.alias("n_rows"), one.alias("n_definite"), F.array().cast("array<string>").alias("verdicts"), "begins")

    out = codes("barcode", "B")
    for frame in (codes("qr_code", "Q"), *keys):
        out = out.unionByName(frame)
    return out


def marking_key(raw: Column, label: Column) -> Column:
    """The key that a raw text is matched by after its codes: that of its label's part number, else its own."""
    return X.normalize(F.coalesce(F.try_element_at(label, F.lit("mpn")), raw))


def _hash(p: Column) -> Column:
    return F.xxhash64(p["kind"], p["probe"])


def probes(scans: DataFrame, looked_up: DataFrame, key: str = "scan_id", raw: str = "raw_input") -> DataFrame:
    """key, layer, place, kind, probe, norm, own (the raw text's key), label (of a structured one, else of a single field). A
    structured label is looked up by its part number after its own payload as a code.

    A text has dozens of probes of which one or none is looked up (kind, probe), so they are tested on a bitmap of these where
    they are made; those that pass are nearly all there, and only they are shuffled to the join."""
    base = scans.select(F.col(key), X.strip(F.col(raw)).alias("raw")).withColumn("label", X.label_fields(F.col("raw")))
    base = base.withColumn("mpn", F.try_element_at("label", F.lit("mpn"))).withColumn("text", F.coalesce("mpn", "raw")).withColumn("norm", X.normalize(F.col("text")))
    base = base.withColumn("field", X.label_fields(F.col("text"), single=True)).withColumn("single", X.normalize(F.try_element_at("field", F.lit("mpn"))))
    base = base.withColumns({"fold": X.fold(F.col("norm")), "own": X.normalize(F.col("raw"))}).where("own <> ''")

    def one(layer: int, kind: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(layer).alias("layer"), F.lit(0).alias("place"), F.lit(kind).alias("kind"), value.alias("probe")))

    def several(layer: int, kind: str, values: Column) -> Column:
        return F.transform(values, lambda v, i: F.struct(F.lit(layer).alias("layer"), i.alias("place"), F.lit(kind).alias("kind"), v.alias("probe")))

    every = F.concat(
        one(BARCODE, "B", F.upper("raw")),
        one(QR, "Q", F.upper("raw")),
        one(LABEL_BARCODE, "B", F.upper("mpn")),
        one(LABEL_QR, "Q", F.upper("mpn")),
        one(KEY, "K", F.col("norm")),
        one(LABEL_FIELD, "K", F.col("single")),
        several(CUT, "K", X.truncations(F.col("norm"))),
        several(GLYPH, "K", F.slice(X.glyph_variants(F.col("norm")), 2, R.MOST_VARIANTS)),
        one(FOLD, "F", F.col("fold")),
        several(FOLD_CUT, "F", X.truncations(F.col("fold"))),
    )
    known = bitmaps.listed(looked_up.select(_hash(F.struct("kind", "probe")).alias("h")))
    base = base.select(key, "norm", "own", "label", "field", F.filter(every, lambda p: F.coalesce(p["probe"], F.lit("")) != "").alias("every"))
    base = base.withColumn("there", known(F.transform("every", _hash)))
    there = F.filter("every", lambda p, i: F.get("there", i))
    return base.select(key, "norm", "own", "label", "field", F.explode(there).alias("p")).select(key, "norm", "own", F.col("label").isNotNull().alias("labelled"), F.coalesce("label", F.when(F.col("p.layer") == LABEL_FIELD, F.col("field"))).alias("label"), "p.*")


def _method(layer: Column, labelled: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair])
    return F.when((layer == KEY) & labelled, "label_mpn").otherwise(F.element_at(named, layer))


def _score(method: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in R.SCORES.items() for x in pair]), method)


def _note(name: str, *texts: Column | str) -> Column:
    return F.format_string(R.NOTES[name], *[F.col(t).cast("string") if isinstance(t, str) else t.cast("string") for t in texts])


def _label_notes(label: str) -> Column:
    """What a label says: its part number, the origin it declares, its lot and date."""
    field = lambda name: F.nullif(F.try_element_at(label, F.lit(name)), F.lit(""))
    dated = F.concat_ws(" / ", field("lot"), field("date_code"))
    return F.array_compact(F.array(F.when(F.col(label).isNotNull(), _note("label", F.try_element_at(label, F.lit("mpn")))), F.when(field("label_coo").isNotNull(), _note("label_coo", field("label_coo"))), F.when(dated != "", _note("label_lot", dated))))


def _row_notes() -> Column:
    """What a key's rows (n_rows, n_definite, verdicts) agree on."""
    left = F.when(F.col("n_definite") > 0, F.col("n_definite")).otherwise(F.col("n_rows"))
    many = F.col("n_rows") > 1
    return F.array_compact(F.array(
        F.when(many & (F.col("n_definite") > 0) & (F.col("n_definite") < F.col("n_rows")), _note("superseded", F.col("n_rows") - F.col("n_definite"))),
        F.when(many & F.col("agreed"), _note("agreed", left)),
        F.when(~F.col("agreed"), _note("conflict", left, F.array_join("verdicts", ", "))),
    ))


_SUGGESTED = "array<struct<component_id:string,score:double,method:string>>"


def _suggested(values: Column | None = None, make=None) -> Column:
    return (F.array() if values is None else F.transform(values, make)).cast(_SUGGESTED)


def _resolved(kind: Column, method: Column, score: Column) -> Column:
    """The key that a match went by, for `trail`; null where no other row has it."""
    there = F.struct(kind.alias("kind"), F.col("probe"), method.alias("method"), score.alias("score"), F.col("agreed"))
    return F.when(F.col("n_rows") > 1, there)


def cheap_layers(scans: DataFrame, looked_up: DataFrame, key: str = "scan_id", raw: str = "raw_input") -> DataFrame:
    """Scans with a hit in one of the layers 1 to 10: key, method, score, component (null: conflict), normalized_input, notes, suggestions, resolved."""
    hits = probes(scans, looked_up, key, raw).join(looked_up.select("kind", "probe").hint("merge"), ["kind", "probe"])
    first = hits.groupBy(key).agg(F.min_by(F.struct("layer", "labelled", "label", "norm", "own", "kind", "probe"), F.struct("layer", "place")).alias("h")).select(key, "h.*")
    found = first.join(looked_up.hint("merge"), ["kind", "probe"])
    layer = F.col("layer")
    method = _method(layer, F.col("labelled"))
    how = F.when(layer == CUT, _note("cut", "norm", "probe")).when(layer == GLYPH, _note("glyph", "norm", "probe")).when(layer == FOLD, _note("fold", "norm", "probe")).when(layer == FOLD_CUT, _note("fold_cut", "norm"))
    notes = F.when(layer <= QR, F.array().cast("array<string>")).otherwise(F.concat(_label_notes("label"), F.array_compact(F.array(how)), F.when(layer >= KEY, _row_notes()).otherwise(F.array().cast("array<string>"))))
    read_as = F.when(layer <= QR, F.col("own")).when(layer.isin(LABEL_FIELD, CUT, GLYPH), F.col("probe")).otherwise(F.col("norm"))
    passed = F.when(layer.isin(KEY, LABEL_FIELD), F.lit("normalized")).otherwise(method)  # what a label resolves by is its part number's key
    return found.select(
        key, F.when(F.col("agreed"), method).otherwise("conflict").alias("method"), _score(method).alias("score"), "component", read_as.alias("normalized_input"), notes.alias("notes"),
        _suggested().alias("suggestions"), _resolved(F.col("kind"), passed, _score(method)).alias("resolved"),
    )


def _prefixes_of(text: Column, lengths: list[int]) -> Column:
    """The text's prefixes of these lengths."""
    known = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    return F.transform(F.filter(known, lambda n: n <= F.length(text)), lambda n: F.substring(text, F.lit(1), n))


def _first(rows: DataFrame, by: list[str], k: int, *order: str) -> DataFrame:
    """The first k rows of each group, with their place. Spark limits the rank before it shuffles, so a group brings at most k rows a task."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def prefixed_keys(markings: DataFrame, looked_up: DataFrame) -> DataFrame:
    """norm, n, keys, rows, stored: for each marking (norm, distinct) that begins a stored key, or that a stored key begins, the
    length of the longest such keys, how many there are, their rows, and the first of them.

    Stored keys that begin with a marking come from a table of prefixes, of asked lengths alone: one row a prefix, so a marking
    meets one row of it, however many keys begin with it. Keys that a marking begins with are met by its own prefixes, of stored
    lengths alone.
    """
    asked = markings.where(F.length("norm") >= R.PREFIX_FLOOR)
    keys = looked_up.where("kind = 'K'").select(F.col("probe").alias("stored"), "n_rows")
    # Only prefixes of lengths that the other side has can be equal to one of it; lengths are few whatever the rows.
    lengths = lambda df, c: sorted(df.agg(F.collect_set(F.length(c))).first()[0])
    table = keys.select("stored", "n_rows", F.explode(_prefixes_of(F.col("stored"), lengths(asked, "norm"))).alias("norm"))
    table = table.groupBy("norm", F.length("stored").alias("n")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n_rows").alias("rows"), F.min("stored").alias("stored"))
    table = table.groupBy("norm").agg(F.max_by(F.struct("n", "keys", "rows", "stored"), "n").alias("t"))
    begun = asked.select("norm", F.explode(_prefixes_of(F.col("norm"), lengths(keys, "stored"))).alias("stored")).join(keys, "stored")
    begun = begun.groupBy("norm").agg(F.max_by(F.struct(F.length("stored").alias("n"), F.lit(1).cast("long").alias("keys"), F.col("n_rows").alias("rows"), "stored"), F.length("stored")).alias("b"))
    both = asked.join(table, "norm", "left").join(begun, "norm", "left").withColumn("x", F.coalesce("t", "b"))
    return both.where("x is not null").select("norm", "x.*")


def _listed(ambiguous: DataFrame, looked_up: DataFrame, live: DataFrame) -> DataFrame:
    """norm, listed: the ids of the first rows of the longest keys that begin with a marking (norm, n), keys in the order of their own first rows."""
    keys = looked_up.where("kind = 'K'").select(F.col("probe").alias("stored"), "begins")
    lengths = sorted(r.n for r in ambiguous.select(F.length("norm").alias("n")).distinct().collect())
    met = keys.select("stored", "begins", F.length("stored").alias("n"), F.explode(_prefixes_of(F.col("stored"), lengths)).alias("norm")).join(ambiguous.select("norm", "n"), ["norm", "n"])
    few = cut(_first(met, ["norm"], R.AMBIGUOUS_KEPT, "begins").select("norm", "stored", "begins"), "prefix-keys")
    rows = live.select("ord", "component_id", F.col("search_key").alias("stored")).join(few.select("stored").distinct(), "stored", "left_semi")
    rows = _first(rows, ["stored"], R.AMBIGUOUS_KEPT, "ord").drop("place")
    first = _first(few.join(rows, "stored"), ["norm"], R.AMBIGUOUS_KEPT, "begins", "ord")
    return first.groupBy("norm").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "component_id"))), lambda x: x["component_id"]).alias("listed"))


def prefix_layer(scans: DataFrame, looked_up: DataFrame, live: DataFrame, key: str = "scan_id") -> DataFrame:
    """scans (key, norm) with stored keys that the marking begins with, or that begin with it; the longest stored keys count."""
    found = cut(prefixed_keys(scans.select("norm").distinct(), looked_up), "prefix-found")
    one = F.col("keys") == 1
    known = looked_up.where("kind = 'K'").drop("kind").withColumn("stored", F.col("probe"))
    top = found.join(known.drop("begins"), "stored").join(_listed(found.where(~one), looked_up, live), "norm", "left")
    score = F.lit(R.SCORES["prefix"])
    top = top.select(
        "norm", F.when(~one, "ambiguous_prefix").when(F.col("agreed"), "prefix").otherwise("conflict").alias("method"), F.when(one, score).otherwise(0.0).alias("score"), F.when(one, F.col("component")).alias("component"),
        F.when(one, F.concat(F.array(F.lit(R.NOTES["prefix"])), _row_notes())).otherwise(F.array(_note("ambiguous_prefix", "rows"))).alias("notes"),
        F.when(one, _suggested()).otherwise(_suggested(F.col("listed"), lambda x: F.struct(x.alias("component_id"), F.lit(R.AMBIGUOUS_SCORE).alias("score"), F.lit("prefix").alias("method")))).alias("suggestions"),
        F.when(one, _resolved(F.lit("K"), F.lit("prefix"), score)).alias("resolved"),
    )
    return scans.select(key, "norm").join(top.hint("merge"), "norm").select(key, "method", "score", "component", F.col("norm").alias("normalized_input"), "notes", "suggestions", "resolved")


def fuzzy_layer(scans: DataFrame, catalogue: DataFrame, key: str = "scan_id") -> DataFrame:
    """scans (key, norm) against the 200 catalogue rows that share most 3-grams, by similarity; distinct markings are compared once."""
    found = fuzzy.nearest(scans.select("norm").distinct(), catalogue).join(catalogue.select("ord", F.struct(*CARRIED).alias("component")).hint("merge"), "ord").drop("ord")
    hit = F.coalesce(F.col("best") >= R.FUZZY_ACCEPT, F.lit(False))
    tie = hit & F.coalesce(F.col("second") >= F.col("best") - R.FUZZY_MARGIN, F.lit(False))
    five = _suggested(F.coalesce("five", F.array()), lambda x: F.struct(x["component_id"].alias("component_id"), x["score"].alias("score"), F.lit("fuzzy").alias("method")))
    return scans.select(key, "norm").join(found.hint("merge"), "norm", "left").select(
        key, F.when(tie, "ambiguous_fuzzy").when(hit, "fuzzy").otherwise("none").alias("method"), F.coalesce("best", F.lit(0.0)).alias("score"), F.when(hit & ~tie, F.col("component")).alias("component"), F.col("norm").alias("normalized_input"),
        F.when(tie, F.array(F.lit(R.NOTES["ambiguous_fuzzy"]))).otherwise(F.array().cast("array<string>")).alias("notes"), F.when(hit & ~tie, F.slice(five, 2, 4)).otherwise(five).alias("suggestions"), F.lit(None).cast(_RESOLVED).alias("resolved"),
    )


_RESOLVED = "struct<kind:string,probe:string,method:string,score:double,agreed:boolean>"


def match(scans: DataFrame, catalogue: DataFrame, key: str = "scan_id", raw: str = "raw_input") -> DataFrame:
    """key, matched, method, score, component, normalized_input, notes, suggestions, resolved for every scan, by the whole cascade.

    Distinct raw texts are matched once. normalized_input is the key that was found by, as it was repaired or shortened.
    suggestions are the scored rows of prefix and fuzzy layers, ten at most; the rows that share a key, as many as they are, are
    in `trail`, by `resolved`.
    """
    found = matched_texts(scans, catalogue, raw)
    asked = scans.select(F.col(key), F.coalesce(F.col(raw), F.lit("")).alias("raw_text"))
    return asked.join(found.hint("merge"), "raw_text").drop("raw_text").withColumn("matched", F.col("component").isNotNull())


def matched_texts(scans: DataFrame, catalogue: DataFrame, raw: str = "raw_input", looked_up: DataFrame | None = None) -> DataFrame:
    """raw_text (distinct; a null one is ''), method, score and the others of `match`, stored. looked_up is the catalogue's
    `lookups`, where they are stored already."""
    live = catalogue.where("not is_deleted") if "is_deleted" in catalogue.columns else catalogue
    live = cut(live.select("ord", *CARRIED, "barcode", "qr_code"), "cascade-catalogue")  # each layer reads it, and what is looked up, again
    looked_up = cut(lookups(live), "cascade-lookups") if looked_up is None else looked_up
    texts = cut(scans.select(F.coalesce(F.col(raw), F.lit("")).alias("raw_text")).distinct(), "cascade-texts")
    text_key = "raw_text"
    cheap = cut(cheap_layers(texts, looked_up, text_key, text_key), "cascade-cheap")
    label = X.label_fields(F.col(text_key))
    left = texts.join(cheap.select(text_key).hint("merge"), text_key, "left_anti").select(text_key, label.alias("label"), marking_key(F.col(text_key), label).alias("norm"))
    left = cut(left, "cascade-left")
    none = left.where("norm = ''").select(
        text_key, F.lit("none").alias("method"), F.lit(0.0).alias("score"), F.lit(None).cast(cheap.schema["component"].dataType).alias("component"), F.lit("").alias("normalized_input"),
        F.array(F.lit(R.NOTES["empty"])).alias("notes"), _suggested().alias("suggestions"), F.lit(None).cast(_RESOLVED).alias("resolved"),
    )
    some = left.where("norm <> ''")
    prefixed = cut(prefix_layer(some, looked_up, live, text_key), "cascade-prefixed")
    rest = cut(some.join(prefixed.select(text_key).hint("merge"), text_key, "left_anti").select(text_key, "norm"), "cascade-rest")
    later = prefixed.unionByName(fuzzy_layer(rest, live, text_key)).unionByName(none)
    later = later.join(left.select(text_key, "label").hint("merge"), text_key).withColumn("notes", F.concat(_label_notes("label"), "notes")).drop("label")
    return cut(cheap.unionByName(later), "cascade-found")


def trail(matches: DataFrame, catalogue: DataFrame, key: str = "scan_id") -> DataFrame:
    """key, rank, component_id, score, method: each match's other rows. Those of a conflict are all rows that share the key (but
    those of unknown origin, where others are known), in the catalogue's order; those of an agreed key are the rows after its
    first; those of prefix and fuzzy layers are the match's suggestions.

    Only rows of keys that some match went by are ranked, and in ranges, so a key that a third of the catalogue shares is no
    task's work.
    """
    live = catalogue.where("not is_deleted") if "is_deleted" in catalogue.columns else catalogue
    by = ["kind", "probe"]
    went = matches.where("resolved is not null").select(key, "resolved.*")
    wanted = cut(went.select(*by).distinct(), "trail-keys")
    held = live.where("search_key <> ''").select("ord", "component_id", (_flag("is_chinese") == "UNKNOWN").alias("vague"), F.explode(F.array(F.struct(F.lit("K").alias("kind"), F.col("search_key").alias("probe")), F.struct(F.lit("F").alias("kind"), X.fold(F.col("search_key")).alias("probe")))).alias("k"))
    held = held.select("ord", "component_id", "vague", "k.*").join(wanted.hint("merge"), by, "left_semi")
    rows = cut(ranked(held, by, ["vague", "ord"]), "trail-rows")
    vague_only = rows.groupBy(*by).agg(F.min("vague").alias("all_vague"))
    rows = rows.join(vague_only.hint("merge"), by).where("not vague or all_vague").drop("vague", "all_vague", "ord")
    shared = went.join(rows.hint("merge"), by).withColumn("rank", F.col("place") - F.col("agreed").cast("int")).where("rank > 0").select(key, "rank", "component_id", "score", "method")
    listed = matches.select(key, F.posexplode("suggestions").alias("at", "s")).select(key, (F.col("at") + 1).alias("rank"), "s.component_id", "s.score", "s.method")
    return shared.unionByName(listed)
