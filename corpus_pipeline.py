"""From raw documents to packed training sequences, in five stages; each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from origintrace.llm import langid, minhash, mixing, packing, suffixes
from origintrace.llm.common import table
from origintrace.session import drop, dropped_afterwards, scratch_path

ENTROPY_GAIN, MAX_REPEATS = 0.5, 4.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence names; those without text or of no known language go."""
    return langid.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    return minhash.keep_first(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that occur earlier."""
    return suffixes.remove_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources repeated, half the way to the even mix and up to four times."""
    return mixing.remix(docs, entropy_gain=ENTROPY_GAIN, max_repeats=MAX_REPEATS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences of 4096 tokens. `packing.pack_documents` gives their token
    ids too where they are asked for."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: SQL can't express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result. A stage's own tables, and its input, are dropped once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with dropped_afterwards(spark):
            out = stage(spark, docs, sf_dir)
            schema = out.schema
            out.write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
