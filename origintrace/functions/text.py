"""Keys of markings as column expressions; everything but the distance stays in the JVM."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..rules import tables as R
from . import distances as D

#: What surrounding white space is: the ASCII separators count too.
_EDGE = r"^[\x09-\x0d\x1c-\x20\x85\xa0]+|[\x09-\x0d\x1c-\x20\x85\xa0]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), _EDGE, "")


def normalize(c: Column) -> Column:
    """Upper case without noise prefixes (each taken off once, in order) and without anything but A-Z and 0-9; null is ''."""
    v = F.upper(strip(c))
    for p in R.NOISE_PREFIXES:
        v = F.regexp_replace(v, f"^{p}", "")
    return F.regexp_replace(v, "[^A-Z0-9]", "")


def fold(key: Column) -> Column:
    """Every glyph of a confusion class as one; key is normalised."""
    return F.translate(key, R.FOLD_FROM, R.FOLD_TO)


def truncations(key: Column, floor: int = R.TRUNCATION_FLOOR) -> Column:
    """Leading substrings, longest first, down to floor characters."""
    n = F.length(key)
    return F.when(n > floor, F.transform(F.sequence(n - 1, F.lit(floor), F.lit(-1)), lambda i: F.substring(key, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def glyph_variants(key: Column, most: int = R.MOST_VARIANTS) -> Column:
    """The key and its re-readings with one confusable glyph replaced, by place, the forward table first; at most `most`.

    Each table is applied to the whole key once; a place is re-read where that has changed it. Re-readings at different places
    differ, so only the two of one place can be equal.
    """
    backward = {b: a for a, b in R.GLYPH_PAIRS}  # of several glyphs for one, the last
    one, two = (F.translate(key, "".join(t), "".join(t.values())) for t in (dict(R.GLYPH_PAIRS), backward))
    glyph = lambda c, i: F.substring(c, i, F.lit(1))

    def read(t: Column) -> Column:
        places = F.when(F.length(t["key"]) > 0, F.sequence(F.lit(1), F.length(t["key"]))).otherwise(F.array().cast("array<int>"))
        changed = F.filter(places, lambda i: (glyph(t["one"], i) != glyph(t["key"], i)) | (glyph(t["two"], i) != glyph(t["key"], i)))

        def at(i: Column) -> Column:
            old, new, other = (glyph(t[c], i) for c in ("key", "one", "two"))
            with_glyph = lambda g: F.concat(F.substring(t["key"], F.lit(1), i - 1), g, F.substring(t["key"], i + 1, F.lit(1 << 30)))
            return F.array(F.when(new != old, with_glyph(new)), F.when((other != old) & (other != new), with_glyph(other)))

        return F.concat(F.array(t["key"]), F.array_compact(F.flatten(F.transform(changed, at))))

    # Bound to a lambda's variable, the tables are applied once a key.
    once = F.transform(F.array(F.struct(key.alias("key"), one.alias("one"), two.alias("two"))), read)
    return F.slice(F.element_at(once, 1), 1, most)


def grams(key: Column, n: int = R.GRAM) -> Column:
    """Distinct n-grams; a shorter key is its own."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key) - n + 1)), lambda i: F.substring(key, i, F.lit(n))))


def prefixes(key: Column, least: int = 1) -> Column:
    n = F.length(key)
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), n), lambda i: F.substring(key, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(IntegerType())
def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    every = np.arange(len(a))
    return pd.Series(D.osa_and_prefix(D.Texts.of(a.tolist()), D.Texts.of(b.tolist()), every, every)[0])


def osa_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: edits and swaps of neighbours, no substring edited twice; a null a is '', a null b has none."""
    return F.when(b.isNotNull(), _osa(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))


def common_prefix(a: Column, b: Column) -> Column:
    """Letters that both begin with; the first dozen are told without a loop."""
    n = F.least(F.length(a), F.length(b))
    beyond = F.size(F.filter(F.sequence(F.lit(13), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    told = F.when(n < 1, 0)
    for i in range(1, 13):
        told = told.when((n < i) | (F.substring(a, F.lit(1), F.lit(i)) != F.substring(b, F.lit(1), F.lit(i))), i - 1)
    return told.when(n == 12, 12).otherwise(F.lit(12) + beyond)


def similarity(a: Column, b: Column, distance: Column | None = None) -> Column:
    """0 to 100: three quarters from the distance, one quarter from the common prefix; two decimals, ties to even."""
    longest = F.greatest(F.length(a), F.length(b)).cast("double")
    d = osa_distance(a, b) if distance is None else distance
    score = (F.lit(1.0) - d / longest) * 100 * 0.75 + common_prefix(a, b) / longest * 100 * 0.25
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 100.0).otherwise(F.bround(score, 2))


def label_fields(raw: Column, single: bool = False) -> Column:
    """map of field -> value of a reel or bag label; null if raw is none (no part number, or neither structured nor, with
    single, one field). The first value of a field counts; two-digit parts are headers."""
    s = strip(raw)
    structured = s.startswith("[)>") | s.rlike(r"[\x1d\x1e\x04]")
    body = F.when(s.startswith("[)>"), F.substring(s, 4, 1 << 30)).otherwise(s)
    parts = F.when(structured, F.filter(F.transform(F.split(body, r"[\x1d\x1e\x04]"), strip), lambda p: F.length(p) > 0)).otherwise(F.array(s))

    def field(p: Column) -> Column:
        name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
        for di, called in reversed(R.LABEL_FIELDS):
            hit = F.upper(p).startswith(di) & (F.length(p) > len(di))
            name = F.when(hit, called).otherwise(name)
            value = F.when(hit, strip(F.substring(p, len(di) + 1, 1 << 30))).otherwise(value)
        return F.struct(name.alias("key"), value.alias("value"))

    named = F.filter(F.transform(F.filter(parts, lambda p: ~p.rlike(r"^[0-9]{2}$")), field), lambda f: f["key"].isNotNull())
    first = F.aggregate(named, F.create_map().cast("map<string,string>"), lambda m, f: F.when(F.map_contains_key(m, f["key"]), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(f["key"]), F.array(f["value"])))))
    usable = F.map_contains_key(first, "mpn") & (structured if not single else F.lit(True))
    return F.when(usable, first)


def manufacturer_key(c: Column, suffixes: bool = True, aliases: dict[str, str] | None = None) -> Column:
    """Upper-case name without dots and commas, with single spaces, without legal suffixes (unless suffixes is false), by alias."""
    v = F.upper(F.regexp_replace(F.regexp_replace(strip(c), "[.,]", ""), r"\s+", " "))
    if suffixes:
        v = F.regexp_replace(strip(F.regexp_replace(v, rf"\b({'|'.join(R.LEGAL_SUFFIXES)})\b", "")), r"\s+", " ")
    table = R.MANUFACTURER_ALIASES if aliases is None else aliases
    if not table:
        return v
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), v), v)


def hashed_id(prefix: Column | str, *parts: Column) -> Column:
    """prefix, dash and the first eight hex digits (upper case) of the SHA-1 of the parts joined by bars."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(prefix, F.lit("-"), F.upper(F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8)))


def component_id(chip: Column, part: Column, name: Column, maker: Column) -> Column:
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    key = normalize(F.coalesce(blank(chip), blank(part), blank(name)))
    return hashed_id(F.when(blank(chip).isNotNull(), "CHIP").otherwise("COMP"), key, manufacturer_key(maker))


def ean13_check(body: Column) -> Column:
    """Check digit of twelve digits: weights 1 and 3 in turn."""
    total = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), lambda s, i: s + F.substring(body, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    return ((F.lit(10) - total % 10) % 10).cast("string")


def synthetic_barcode(cid: Column) -> Column:
    """A valid EAN-13 from the digits of the id's SHA-1, under prefix 890."""
    digits = F.substring(F.regexp_replace(F.sha1(cid), "[^0-9]", ""), 1, 9)
    body = F.substring(F.concat(F.lit("890"), digits, F.lit("0" * 12)), 1, 12)
    return F.concat(body, ean13_check(body))


def qr_payload(cid: Column, chip: Column, part: Column) -> Column:
    return F.concat(F.lit("DCOV:"), cid, F.lit(":"), normalize(F.coalesce(F.nullif(chip, F.lit("")), part)))


def alternatives_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda x: x != "")


def subsystem_of(item: Column) -> Column:
    """The bucket of the first keyword that the text contains, else Other."""
    t = F.upper(F.coalesce(item, F.lit("")))
    return F.coalesce(*[F.when(t.contains(needle), bucket) for needle, bucket in R.SUBSYSTEM_KEYWORDS], F.lit("Other"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as hex, composed of sha2 with the key's two pads."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in block) for p in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def any_of(column: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [column.contains(n) for n in needles])


def register(spark: SparkSession) -> None:
    """SQL functions norm_key and fold_key for this session."""
    upper = "upper(regexp_replace(coalesce(v, ''), '^[\\\\x09-\\\\x0d\\\\x1c-\\\\x20]+|[\\\\x09-\\\\x0d\\\\x1c-\\\\x20]+$', ''))"
    for p in R.NOISE_PREFIXES:
        upper = f"regexp_replace({upper}, '^{p}', '')"
    key = f"regexp_replace({upper}, '[^A-Z0-9]', '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION norm_key(v STRING) RETURNS STRING RETURN {key}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fold_key(v STRING) RETURNS STRING RETURN translate({key}, '{R.FOLD_FROM}', '{R.FOLD_TO}')")
