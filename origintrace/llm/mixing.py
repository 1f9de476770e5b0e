"""Temperature mixing of sources, in DataFrame operations only.

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected until the weights
have a target entropy, or until no source is repeated more often than a limit. The weights are then realised: every source
gets its part of a token budget as whole passes over its documents plus one partial pass, in a pseudo-random order, and the
copies are dealt into blocks of a fixed token budget that each hold all sources by their weights, permuted inside a block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SECTIONS, PASSES = 64, 6


def word_tokens(text: Column) -> Column:
    """Runs of non-space characters, and one for the end of the document; a null text has only the end."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long") + 1


def _measures(stats: DataFrame, exponents: list[float], total: int) -> list[tuple[float, float, float, float, float]]:
    """(exponent, normaliser, entropy, largest and least weight over share) for each exponent; one small aggregate over the sources."""
    p = F.col("source_tokens") / F.lit(float(total))
    rows = (
        stats.select(p.alias("p"), F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a"))
        .groupBy("a")
        .agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("zl"), F.max(F.pow("p", F.col("a") - 1)).alias("m"), F.min(F.pow("p", F.col("a") - 1)).alias("l"))
        .collect()
    )
    return sorted((r.a, r.z, math.log(r.z) - r.a * r.zl / r.z, r.m / r.z, r.l / r.z) for r in rows)


def solve_exponent(stats: DataFrame, total: int, budget: int, target_entropy: float | None = None, max_repeats: float | None = None, cover: bool = False, highest: float = 8.0) -> float:
    """The exponent by repeated sectioning (each pass tests SECTIONS exponents at once, so it is a bisection in fewer jobs).

    Entropy and repetitions both fall as the exponent rises to 1. With an entropy, the exponent in [0, highest] that has it,
    or the nearest end; with a repetition limit, the smallest exponent up to 1 that keeps it; with both, the entropy's
    exponent unless the limit needs a larger one. Past 1, large sources would be repeated, so a limit that the plain shares
    break (a budget of more than max_repeats corpora) gives 1. With cover, repetitions are those of the budget that shows the
    least repeated source once.
    """

    def section(fits, low: float, high: float) -> float:
        for _ in range(PASSES):
            grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            seen = _measures(stats, grid, total)
            first = next((i for i, m in enumerate(seen) if fits(m)), SECTIONS)
            if first == 0:
                return grid[0]
            low, high = grid[first - 1], grid[first]
        return high

    exponent = 0.0
    if target_entropy is not None:
        exponent = section(lambda m: m[2] <= target_entropy, 0.0, highest)
    if max_repeats is not None and exponent < 1:
        exponent = max(exponent, section(lambda m: (m[3] / m[4] if cover else m[3] * budget / total) <= max_repeats * (1 + 1e-12), exponent, 1.0))
    return exponent


def source_weights(docs: DataFrame, *, source: str = "source", tokens: str = "n_tokens", budget: int | None = None, cover: bool = False, target_entropy: float | None = None, entropy_gain: float | None = None, max_repeats: float | None = None) -> DataFrame:
    """Per source: source_tokens, weight, repeats (passes over the source), and budget and exponent, equal in all rows.

    The target entropy is given as such or, as entropy_gain, as the part of the way from the plain shares' entropy to the
    even mix's. budget defaults to the corpus's tokens; with cover it is what shows every document at least once, times budget/tokens.
    """
    stats = cut(docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("mix_source")).agg(F.sum(tokens).alias("source_tokens")), "mix-sources")
    total = stats.agg(F.sum("source_tokens")).first()[0] or 0
    if not total:
        return stats.select("mix_source", "source_tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("repeats"), F.lit(0).cast("long").alias("budget"), F.lit(1.0).alias("exponent"))
    budget = budget or total
    if entropy_gain is not None:
        even, plain = (m[2] for m in _measures(stats, [0.0, 1.0], total))
        target_entropy = plain + entropy_gain * (even - plain)
    exponent = solve_exponent(stats, total, budget, target_entropy, max_repeats, cover)
    (_, z, *_), = _measures(stats, [exponent], total)
    p = F.col("source_tokens") / F.lit(float(total))
    out = stats.withColumn("weight", F.round(F.pow(p, F.lit(exponent)) / F.lit(z), 12))  # sums of doubles differ by their order beyond that
    if cover:
        least = out.agg(F.min(F.col("weight") / p)).first()[0]
        budget = math.ceil(budget / least)
    return out.select("mix_source", "source_tokens", "weight", (F.col("weight") * F.lit(float(budget)) / F.col("source_tokens")).alias("repeats"), F.lit(budget).cast("long").alias("budget"), F.lit(exponent).alias("exponent"))


def mix(docs: DataFrame, *, source: str = "source", tokens: str | Column = "n_tokens", block_tokens: int = 1 << 20, seed: int = 17, **target) -> DataFrame:
    """docs, one row a copy, with mix_epoch, mix_block and mix_slot (the place in the block, from 0), mix_weight and mix_exponent.

    A null source is the source ''. Null token counts are 1, so no source is without tokens. Repeated rows are rows of their
    own. An empty table gives an empty table. Columns of the input that start with mix_ are replaced. The pseudo-random order
    follows from the rows' contents and the seed alone (repeated rows are told apart by a number), so results don't depend on
    how the table is partitioned.

    The running sum of a source's tokens is a sum over buckets (the square root of the row count in number) plus one inside
    a bucket, so a source with a third of all rows is dealt over as many tasks as the rest.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    base = cut(
        docs.withColumns(
            {
                "mix_source": F.coalesce(F.col(source).cast("string"), F.lit("")),
                "mix_tokens": F.greatest(F.coalesce(tokens, F.lit(1)), F.lit(1)).cast("long"),
                "mix_id": F.monotonically_increasing_id(),
                "mix_key": F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t]),
            }
        ),
        "mix-rows",
    )
    weights = source_weights(base, source="mix_source", tokens="mix_tokens", **target)
    buckets = max(1, math.isqrt(base.count()))
    order = F.xxhash64("mix_key", "mix_copy", F.lit(seed))
    keyed = _numbered_copies(base.select("mix_source", "mix_tokens", "mix_id", "mix_key"))
    keyed = keyed.select("*", order.alias("mix_hash"), F.pmod(F.xxhash64("mix_key", "mix_copy", F.lit(seed + 1)), F.lit(buckets)).alias("mix_bucket"))
    before = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("mix_source", "mix_bucket")
        .agg(F.sum("mix_tokens").alias("mix_sum"))
        .withColumn("mix_offset", F.coalesce(F.sum("mix_sum").over(before), F.lit(0)))
        .join(weights, "mix_source")
        .drop("mix_sum")
    )
    inside = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_hash", "mix_key", "mix_copy").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(offsets, ["mix_source", "mix_bucket"]).withColumn("mix_start", F.col("mix_offset") + F.sum("mix_tokens").over(inside) - F.col("mix_tokens"))
    whole = F.floor("repeats")
    copies = whole + F.when(F.col("mix_start") < (F.col("repeats") - whole) * F.col("source_tokens"), 1).otherwise(0)
    n_blocks = F.ceil(F.col("budget") / F.lit(block_tokens))
    at = (F.col("mix_epoch") * F.col("source_tokens") + F.col("mix_start")) / (F.col("repeats") * F.col("source_tokens"))
    dealt = (
        placed.withColumn("mix_copies", copies.cast("int"))
        .where("mix_copies > 0")
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
        .withColumn("mix_block", F.least(F.floor(at * n_blocks), n_blocks - 1).cast("long"))
    )
    shuffled = Window.partitionBy("mix_block").orderBy(F.xxhash64("mix_key", "mix_copy", "mix_epoch", F.lit(seed + 2)), "mix_key", "mix_copy", "mix_epoch")
    dealt = dealt.select("mix_id", "mix_epoch", "mix_block", (F.row_number().over(shuffled) - 1).cast("long").alias("mix_slot"), F.col("weight").alias("mix_weight"), F.col("exponent").alias("mix_exponent"))
    return base.drop("mix_source", "mix_tokens", "mix_key").join(dealt, "mix_id").drop("mix_id")


def _numbered_copies(rows: DataFrame) -> DataFrame:
    """rows with mix_copy: 0, 1, ... among the rows of one mix_key. Only rows whose key repeats are numbered, inside the parts
    of the written table first, so that a row with a third of all copies is no task's work alone."""
    repeated = rows.groupBy("mix_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mix_key")
    again = rows.join(repeated, "mix_key").select("mix_key", "mix_id", F.shiftright("mix_id", 33).alias("part"))
    before = Window.partitionBy("mix_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = again.groupBy("mix_key", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("mix_key", "part").orderBy("mix_id")) - 1
    numbers = again.withColumn("place", place).join(starts, ["mix_key", "part"]).select("mix_id", (F.col("start") + F.col("place")).cast("long").alias("mix_copy"))
    return rows.join(numbers, "mix_id", "left").withColumn("mix_copy", F.coalesce("mix_copy", F.lit(0).cast("long")))


def remix(docs: DataFrame, **target) -> DataFrame:
    """docs' own columns, a row a copy: every document at least once, the sources that are to weigh more repeated."""
    return mix(docs, tokens=word_tokens(F.col("text")), cover=True, **target).select(*docs.columns)


def op2_temperature_mixing(spark, sf_dir):
    """Mixes all documents half the way from the plain to the even mix, no source more than four times; a row a copy.

    Null sources are one source, a null text is one token, repeated documents are rows of their own, no documents give no rows."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_tokens(F.col("text")).alias("n_tokens"))
    return mix(docs, entropy_gain=0.5, max_repeats=4.0).select(
        "doc_id", "source", "n_tokens", F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_weight").alias("weight"), F.col("mix_exponent").alias("exponent")
    )
