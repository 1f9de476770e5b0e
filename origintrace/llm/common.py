"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, scratch_path as scratch, shared_folder

__all__ = ["bounded_sample", "cut", "few_tasks", "flag_listed", "free_name", "parts", "release", "scratch", "shared_folder", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands texts to Python tasks a few hundred at a time: texts are long, and an executor's memory is shared."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def release() -> None:
    """Gives back the memory that Arrow and the C library keep in a Python worker between tasks."""
    import ctypes
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ROWS_A_TASK, LEAST_TASKS = 20_000, 8


def few_tasks(df: DataFrame, rows: int, each: int = ROWS_A_TASK) -> DataFrame:
    """df, of about so many small rows, in as many tasks as they need: a stage of light work isn't cut into a task for each of the
    session's partitions. Nothing is shuffled for it."""
    return df.coalesce(max(LEAST_TASKS, min(parts(df.sparkSession), -(-rows // each))))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made from it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


BITMAP_BITS = 1 << 23  # a bitmap of ids is at most 131 072 rows of 64 bits


def flag_listed(df: DataFrame, key: str, listed: DataFrame, listed_key: str, flag: str) -> DataFrame:
    """df with a boolean column flag: false only where the key is not among listed's.

    A prefilter that saves shuffling rows with nothing to join: a hashed bitmap of fixed size, so the broadcast is bounded
    whatever the input. False positives, more of them with more ids, are left to the join that follows.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(BITMAP_BITS))
    at, word, bits = (free_name(df, f"bitmap_{n}") for n in ("at", "word", "bits"))
    low = lambda h: F.col(h).bitwiseAND(63).cast("int")
    words = listed.select(place(listed_key).alias("h")).select(F.shiftright("h", 6).alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), low("h")).alias("bit")).groupBy(word).agg(F.bit_or("bit").alias(bits))
    marked = df.withColumn(at, place(key)).withColumn(word, F.shiftright(at, 6)).join(F.broadcast(words), word, "left")
    hit = F.call_function("shiftright", F.col(bits), low(at)).bitwiseAND(1) == 1
    return marked.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(at, word, bits)


def bounded_sample(rows: DataFrame, by: Column, most: int) -> DataFrame:
    """At most `most` rows, to fit a model on: those whose hash of `by` is under a threshold set from the row count (all rows, if
    there are no more). No task holds or sends more than its share of them."""
    n = rows.count()
    kept = rows if n <= most else rows.where(F.pmod(F.xxhash64(by), F.lit(1 << 40)) < int(0.95 * most / n * (1 << 40)))
    return kept.limit(most)
