"""From words read off images to ranked part-number candidates: votes, physical lines, classes, distinct parts.

Input: image_id, text, confidence, engine, variant, level (word or line), and ord for reading order.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ocr import classify_marking, score_candidate
from ..rules import tables as R

LONG_PART, SAME_PART = 8, 0.8


def _readers():
    return F.count_distinct(F.struct("engine", "variant"))


def merged_words(words: DataFrame) -> DataFrame:
    """image_id, word, vote_score, votes: mean confidence, six more for each further engine and variant that agrees, up to four."""
    key = F.regexp_replace(F.upper("text"), "[^A-Z0-9]", "")
    grouped = words.where("level = 'word'").withColumn("word", key).where(F.length("word") >= 2).groupBy("image_id", "word")
    return grouped.agg(F.avg("confidence").alias("mean"), _readers().alias("votes")).select("image_id", "word", (F.col("mean") + F.least(F.col("votes") - 1, F.lit(4)) * 6.0).alias("vote_score"), "votes")


def physical_lines(words: DataFrame) -> DataFrame:
    """image_id, line, votes: lines of several words, and single words in none of these, by how many readings agree."""
    one_space = F.trim(F.regexp_replace(F.upper("text"), r"\s+", " "))
    lines = words.where("level = 'line'").groupBy("image_id", one_space.alias("line")).agg(_readers().alias("votes"))
    covered = lines.select("image_id", F.explode(F.split("line", " ")).alias("line")).distinct()
    singles = words.where("level = 'word'").select("image_id", F.trim(F.upper("text")).alias("line"), "engine", "variant").where("line <> ''")
    singles = singles.join(covered, ["image_id", "line"], "left_anti").groupBy("image_id", "line").agg(_readers().alias("votes"))
    return lines.unionByName(singles)


def ranked_candidates(words: DataFrame, n: int = 12) -> DataFrame:
    """The n best candidates of each image: seven tenths shape, three tenths votes."""
    scored = merged_words(words).withColumn("kind", classify_marking(F.col("word"))).withColumn("score", F.round(0.7 * score_candidate(F.col("word")) + 0.3 * F.col("vote_score"), 6))
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "word")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def by_class(words: DataFrame) -> DataFrame:
    return merged_words(words).withColumn("kind", classify_marking(F.col("word"))).groupBy("image_id", "kind").agg(F.array_sort(F.collect_list("word")).alias("words"))


def ranked_offline(words: DataFrame, n: int = 12) -> DataFrame:
    """The device's ranking: score, then reading order."""
    scored = words.where("level = 'word'").withColumn("score", score_candidate(F.col("text")))
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "ord")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("image_id", "text", "score", "place")


def distinct_parts(words: DataFrame) -> DataFrame:
    """image_id, parts, multiple: part numbers of at least eight characters, each taken if it is unlike those taken before it.

    The fold depends on order, so an image's candidates pass one task in order; only those taken are held. Every candidate is
    held against all that are taken, by cheap bounds of the likeness first.
    """
    long_parts = merged_words(words).where((classify_marking(F.col("word")) == "part_number") & (F.length("word") >= LONG_PART))
    ordered = long_parts.select("image_id", (-F.col("vote_score")).alias("s"), "word").repartition("image_id").sortWithinPartitions("image_id", "s", "word").select("image_id", "word")

    def greedy(batches):
        last, taken, started = None, [], False

        def done():
            return pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([taken], pa.list_(pa.string()))], names=["image_id", "parts"])

        for batch in batches:
            for image, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if started and image != last:
                    yield done()
                    taken = []
                last, started = image, True
                if not any(_same_part(word, t) for t in taken):
                    taken.append(word)
        if started:
            yield done()

    return ordered.mapInArrow(greedy, "image_id string, parts array<string>").withColumn("multiple", F.size("parts") > 1)


def _same_part(word: str, taken: str) -> bool:
    m = SequenceMatcher(None, word, taken)
    return m.real_quick_ratio() >= SAME_PART and m.quick_ratio() >= SAME_PART and m.ratio() >= SAME_PART


def scans_of_images(images: DataFrame) -> DataFrame:
    """One row a scan to make, or a message where none is to be made.

    images: image_id, chips (array of best, full_text; one a package that was told apart), multiple_parts, best, full_text. Each
    package is a scan of its own, numbered from 0; where an image was not told apart and has several part numbers, none is
    picked; else its best marking is the scan.
    """
    apart = F.size(F.coalesce("chips", F.array().cast(images.schema["chips"].dataType))) > 0
    whole = F.array(F.struct(F.col("best"), F.col("full_text")))
    pieces = F.when(apart, F.col("chips")).when(~F.col("multiple_parts") & (F.coalesce("best", F.lit("")) != ""), whole).otherwise(F.array().cast(images.schema["chips"].dataType))
    message = F.when(apart, F.lit(None).cast("string")).when(F.col("multiple_parts"), R.SEVERAL_PARTS).when(F.coalesce("best", F.lit("")) == "", R.NOTHING_READ)
    rows = images.select("image_id", apart.alias("apart"), message.alias("message"), F.posexplode_outer(pieces).alias("chip", "piece"))
    suffix = F.when(F.col("apart"), F.concat(F.lit("-"), F.lpad(F.col("chip").cast("string"), 3, "0"))).otherwise("")
    return rows.select(F.concat(F.substring("image_id", 1, 32), suffix).alias("client_uuid"), "image_id", F.col("piece.best").alias("raw_input"), F.col("piece.full_text").alias("ocr_text"), "message")
