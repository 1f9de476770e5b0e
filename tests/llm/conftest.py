import pathlib
import random
import re

import pytest

from origintrace import llm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def internal_names():
    """Every column name that an operator gives: read from their sources, but for those of results that replace a column of their prefix."""
    named = re.compile(r'alias\("(\w+)"\)|withColumn\("(\w+)"|\bAS (\w+)|withColumnRenamed\("\w+", "(\w+)"\)|free_name\(\w+, f?"(\w+)"')
    found = {next(filter(None, m.groups())) for path in pathlib.Path(llm.__file__).parent.glob("*.py") for m in named.finditer(path.read_text().split("_SQL = ")[0])}
    listed = {"bitmap_at", "bitmap_word", "bitmap_bits", "wanted", "guest", "offset", "sequence_id", "digest", "stop", "anchor"}
    return sorted(n for n in found | listed if not n.startswith(("rep_", "lid_", "mix_", "pack_", "hs_")) and n.lower() not in {"doc_id", "text", "lang", "source", "n_chars"})


#: Names that the operators use themselves.
CLASHES = [*internal_names(), "mix_block", "mix_id", "lid_lang", "rep_text", "pack_id"]


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def documents():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, shared passages, ties."""
    base, passage = words(1, 300), words(2, 60)
    near = base.split()
    near[7] = "changed"
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, "one two", "en", "b", 7),
        (5, "One TWO", "en", "b", 7),
        (6, base, "en", "a", len(base)),
        (7, base, "fr", "a", len(base)),
        (8, " ".join(near), "en", None, None),
        (9, words(3, 20_000), "de", "a", None),
        (10, f"{words(4, 30)} {passage} {words(5, 30)}", "en", "a", None),
        (11, f"{words(6, 25)} {passage} {words(7, 41)}", "en", "c", None),
        (12, "é" * 90 + "aa" * 200, None, "c", None),
        (13, "x" * 1000, "en", "c", None),
        (14, words(8, 50), "en", "a", None),
        (14, words(8, 50), "en", "a", None),
        (None, words(9, 40), "en", "a", None),
        (None, f"{words(10, 10)} {passage}", None, None, None),
        (-3, words(11, 12), "en", "a", None),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with more columns, named as operators name theirs."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("mine") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
