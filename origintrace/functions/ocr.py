"""Classes and scores of words read off a package, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import tables as R


def classify_marking(text: Column) -> Column:
    up = F.upper(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(up, r"\s+", "")
    vendor = t.rlike(f"^(?:{'|'.join(R.VENDOR_WORDS)}).{{0,2}}$")
    return (
        F.when(t == "", "noise")
        .when(up.rlike(R.RE_COUNTRY), "country_of_origin")
        .when(vendor, "vendor")
        .when(t.isin(R.NOISE_WORDS), "noise")
        .when(t.rlike(R.RE_DATE) & (F.length(t) == 4), "date_code")
        .when(t.rlike(R.RE_PART) & t.rlike("[0-9]") & (F.length(t) >= 5), "part_number")
        .when(t.rlike(R.RE_LOT), "lot_code")
        .otherwise("other")
    )


def score_candidate(text: Column) -> Column:
    """How likely the text is the part number to look up: its class's score, by length and by its mix of letters and digits."""
    t = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")
    kind = classify_marking(text)
    n, letters, digits = F.length(t), t.rlike("[A-Z]"), t.rlike("[0-9]")
    base = F.coalesce(*[F.when(kind == k, v) for k, v in R.CLASS_SCORES.items()])
    return base + F.when((n >= 8) & (n <= 16), 12.0).when(n < 6, -20.0).otherwise(0.0) + F.when(letters & digits, 8.0).otherwise(0.0) - F.when(digits & ~letters, 15.0).otherwise(0.0)
