"""Language identification by Bayesian evidence fusion.

Evidence of a row: the likelihood of its text under a character model of each language, the language its markup declares, the
suffix of its address, and a prior of its host. What declarations and suffixes say, and the priors, are counted over all rows
by grouped aggregation of the text posteriors; a host's prior is smoothed to its domain's and that to the global one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, small_batches, table
from .url_filters import host_of

FIT_ROWS = 4000  # the character model is fitted on so many labelled rows in all (by hash, in equal shares of the languages), on their whole texts
LEAST_FIT_ROWS = 50  # a language's share, where there are so many languages that an equal one would be smaller
BINS = 1 << 15
HELD_TRIGRAMS, HELD_SCORES = 1 << 18, 1 << 20  # of a text at once; and scores of trigrams, a language each, that are added up at once
UNKNOWN = "und"
FULL_GRAMS = 40  # a text's mean log-likelihood a trigram counts as that of so many independent trigrams at most
PRIOR_ROWS = 20.0  # rows that the parent's prior counts as
ODD_RATE = 0.02  # share of rows that declare none of what their language usually declares

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 13) else c for c in range(256))


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Bins of the byte trigrams of the text, A-Z in lower case, with a space at each end, so many at a time: a long text is never
    held as numbers as a whole."""
    raw = b" " + text.encode("utf-8", "surrogatepass").translate(_LOWER) + b" "
    for at in range(0, len(raw) - 2, HELD_TRIGRAMS):
        b = np.frombuffer(raw, dtype=np.uint8, offset=at, count=min(HELD_TRIGRAMS + 2, len(raw) - at)).astype(np.uint32)
        yield (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(17)


class Model:
    """Log-probabilities of trigram bins, one column a language; the last, UNKNOWN, has all bins alike."""

    def __init__(self, counts: dict[str, np.ndarray]):
        """counts: the trigram bins' counts of each language."""
        names = sorted(counts)
        self.languages = [*names, UNKNOWN]
        self.table = np.full((BINS, len(self.languages)), -math.log(BINS), dtype=np.float32)
        for i, name in enumerate(names):
            smoothed = 0.05 + counts[name]
            self.table[:, i] = np.log(smoothed / smoothed.sum())

    def score(self, text: str | None) -> np.ndarray:
        """Tempered log-likelihoods; zeros for a text without a letter, of which nothing is known."""
        total, n = np.zeros(len(self.languages)), 0
        step = max(1, HELD_SCORES // len(self.languages))
        for grams in trigrams(text) if text and not text.isspace() else ():
            n += len(grams)
            for at in range(0, len(grams), step):
                total += self.table[grams[at : at + step]].sum(axis=0, dtype=np.float64)
        return total / n * min(n, FULL_GRAMS) if n else total


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = FIT_ROWS) -> Model:
    """Fits the character model on the whole texts of about `rows` labelled rows; the bound is on the fit alone.

    Labels are counted over all rows and every one is a language of the model, however rare. Each has an equal share of the rows
    (LEAST_FIT_ROWS at least): those whose hash of key and text is under a threshold from the label's count, and the one of the
    smallest hash, so that none is left without. Equal texts of a language count once. Trigrams are counted in tasks; the driver
    gets counts, BINS a language at most, and no texts.
    """
    named = F.lower(F.trim(label))
    usable = small_batches(labelled).where(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.trim(label) != ""))
    usable = usable.select(F.col(text).alias("t"), named.alias("l"), F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 40)).alias("h"))
    counted = usable.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()
    if not counted:
        return Model({})
    share = max(rows // len(counted), LEAST_FIT_ROWS)
    names = sorted(c.l for c in counted)
    most = [(c.l, names.index(c.l), max(c.least, int(0.95 * share / c.n * (1 << 40))) if c.n > share else 1 << 40) for c in counted]
    limits = labelled.sparkSession.createDataFrame(most, "l string, place int, most long")

    def count(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, place in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found.setdefault(place, np.zeros(BINS, dtype=np.int64))
                for grams in trigrams(t.as_py()):
                    found[place] += np.bincount(grams, minlength=BINS)
        for place, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), place), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["place", "bin", "n"])
        release()

    held = usable.join(F.broadcast(limits), "l").where("h <= most").select("t", "place").distinct().mapInArrow(count, "place int, bin int, n long")
    sums = held.groupBy("place", "bin").agg(F.sum("n").alias("n")).toPandas()
    counts = {name: np.zeros(BINS) for name in names}
    for place, part in sums.groupby("place"):
        counts[names[place]][part["bin"].to_numpy()] = part["n"].to_numpy()
    return Model(counts)


HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def text_likelihoods(model: Model, markup: bool = False):
    """A vectorised function text -> array<double>, in the model's order of languages; markup: tags, scripts and styles are left out."""

    @F.arrow_udf("array<double>")
    def likelihoods(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores = []
            for t in texts:
                t = t.as_py()
                scores.append(model.score(HIDDEN.sub(" ", t) if markup and t else t).tolist())
            yield pa.array(scores, pa.list_(pa.float64()))
        release()

    return likelihoods


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body has it; inside a lambda it would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _share(values: Column) -> Column:
    return _let(values, lambda a: _let(_total(a), lambda t: F.transform(a, lambda x: x / t)))


def _posterior(logs: Column) -> Column:
    """exp(logs) normalised to one, in time linear in the languages."""
    return _share(_let(logs, lambda a: _let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _sums(rows: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.col("lid_post")[i]) for i in range(n)]).alias(name))


def _less(a: Column, b: Column) -> Column:
    """a without b, not below zero."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))


def identify(rows: DataFrame, model: Model, *, text: str, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, domain: Column | None = None, markup: bool = False) -> DataFrame:
    """rows with lid_lang, lid_confidence and lid_text_lang (the text's evidence alone).

    A text that is null, empty or only spaces is UNKNOWN with confidence 0 whatever else is known. Evidence that is not given
    takes no part; where it is null in a row it has no say (declared, suffix) or leaves the parent's prior (host; its parent is
    the domain's, and that one's all rows'). No row is evidence for itself: what its own text says is taken out of what its host,
    declaration and suffix say. Of equal posteriors the first language in alphabetical order is taken. Input columns that start
    with lid_ are replaced; repeated rows get equal results; an empty table an empty one.

    The statistics are one row a host, domain, declaration and suffix, written to tables so that Spark knows their size: small
    ones are broadcast, large ones shuffled with AQE splitting a hot host. Texts are scored twice rather than shuffled, and
    what a caller doesn't select of rows is not carried through the joins.
    """
    rows = small_batches(rows).drop(*[c for c in rows.columns if c.startswith("lid_")])
    n = len(model.languages)
    likelihoods = text_likelihoods(model, markup)
    missing = F.col(text).isNull() | (F.regexp_count(F.col(text), F.lit(r"\S")) == 0) if not markup else F.col(text).isNull()
    given = {"lid_declared": None if declared is None else F.lower(F.trim(declared)), "lid_suffix": suffix, "lid_domain": domain, "lid_host": host}
    given = {name: F.coalesce(c, F.lit("")) for name, c in given.items() if c is not None}
    places = [c for c in ("lid_host", "lid_domain") if c in given]
    scored = rows.withColumns({"lid_ll": likelihoods(F.col(text)), **given})
    scored = scored.withColumns({"lid_post": _posterior(F.col("lid_ll")), "lid_silent": missing | (F.array_min("lid_ll") == 0) & (F.array_max("lid_ll") == 0)})
    seen = scored.groupBy(*given).agg(*[F.sum(F.col("lid_post")[i]).alias(f"p{i}") for i in range(n)])
    seen = cut(seen.select(*given, F.array(*[F.coalesce(f"p{i}", F.lit(0.0)) for i in range(n)]).alias("lid_post")), "langid-counts")
    whole = seen.agg(*[F.sum(F.col("lid_post")[i]) for i in range(n)]).first()
    mass = np.array([x or 0.0 for x in whole])
    rows_in_all = float(mass.sum())
    vector = lambda values: F.array(*[F.lit(float(v)) for v in values])
    overall = vector((mass + 1 / n) / (rows_in_all + 1))
    smooth = lambda counts, parent: _add(counts, F.transform(parent, lambda p: p * PRIOR_ROWS))  # noqa: E731  not normalised: the posterior is
    fused, prior = scored, overall
    if places:
        parents = _sums(seen, ["lid_domain"], n, "dn").select("lid_domain", _share(smooth(F.col("dn"), overall)).alias("lid_parent")) if "lid_domain" in given else None
        known = _sums(seen, places, n, "lid_hn")
        known = known.join(parents, "lid_domain") if parents is not None else known.withColumn("lid_parent", overall)
        fused = fused.join(cut(known, "langid-hosts"), places)
        prior = smooth(_less(F.col("lid_hn"), F.col("lid_post")), F.col("lid_parent"))
        prior = F.when(F.col(places[0]) == "", F.col("lid_parent")).otherwise(prior)
    logs = _add(F.col("lid_ll"), F.transform(prior, lambda p: F.log(p)))
    for by in ("lid_declared", "lid_suffix"):
        if by in given:
            said = f"{by}_n"
            fused = fused.join(cut(_sums(seen, [by], n, said), f"langid-{by}"), by)
            logs = _add(logs, F.when(F.col(by) != "", _says(F.col(said), vector(mass), rows_in_all)).otherwise(vector([0.0] * n)))
    names = F.array(*[F.lit(x) for x in model.languages])
    pick = lambda a: names[F.array_position(a, F.array_max(a)).cast("int") - 1]
    silent = F.col("lid_silent")
    fused = fused.withColumn("lid_all", _posterior(logs))
    return fused.select(
        *rows.columns,
        F.when(silent, UNKNOWN).otherwise(pick(F.col("lid_all"))).alias("lid_lang"),
        F.when(silent, 0.0).otherwise(F.array_max("lid_all")).alias("lid_confidence"),
        F.when(silent, UNKNOWN).otherwise(pick(F.col("lid_ll"))).alias("lid_text_lang"),
    )


def _says(counts: Column, mass: Column, rows: float) -> Column:
    """log P(value | language) by all rows but this one, smoothed so that a value not seen with a language still has ODD_RATE of
    its share; a value that no other row has says the same of every language."""
    others, rest = _less(counts, F.col("lid_post")), _less(mass, F.col("lid_post"))
    rate = lambda t: F.zip_with(others, rest, lambda c, m: F.log((c + ODD_RATE * t) / (m + ODD_RATE * max(rows - 1, 0.0) + 1e-9) + 1e-9))
    return _let(_total(others), rate)


LEAST_CONFIDENCE = 0.5


def accepted() -> Column:
    return (F.col("lid_lang") != UNKNOWN) & (F.col("lid_confidence") >= LEAST_CONFIDENCE)


def filter_documents(docs: DataFrame) -> DataFrame:
    """docs that have a language: their own columns, no others. The declared language is lang, the host is source."""
    found = identify(docs, fit(docs), text="text", declared=F.col("lang"), host=F.col("source"))
    return found.where(accepted()).select(*docs.columns)


def op5_language_evidence(spark, sf_dir):
    """The language of every page; the character model is fitted on labelled documents.

    A null or empty html is UNKNOWN with confidence 0; null addresses and declarations have no say; repeated pages get equal rows."""
    host = host_of(F.col("url"))
    labels = F.split(host, r"\.")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = identify(
        pages,
        fit(table(spark, sf_dir, "documents")),
        text="html",
        declared=F.nullif(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1), F.lit("")),
        suffix=F.nullif(F.element_at(labels, -1), F.lit("")),
        host=F.nullif(host, F.lit("")),
        domain=F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        markup=True,
    )
    return found.select("page_id", host.alias("host"), F.col("lid_lang").alias("lang"), F.round("lid_confidence", 6).alias("confidence"), F.col("lid_text_lang").alias("text_lang"), accepted().alias("accepted"))
