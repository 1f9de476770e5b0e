"""Spelling variants: words of a corpus that differ by one code point, by full neighbourhood generation.

Every distinct deletion, replacement and insertion over the observed alphabet is generated for each word of the vocabulary and
joined by equality with the vocabulary itself, so whatever meets is one edit away and no distance is computed. A word makes
some thousand candidates of which a handful exist, so they are generated as hashes, from sums over the word's prefixes, and
tested on a bitmap of the vocabulary; only those that pass are spelt out and shuffled to the join, which is by the words
themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

LEAST_LENGTH, LEAST_COUNT = 6, 5
RATIO = 5  # a word's form is at least so many times as frequent
TYPO_ONE_IN = 199
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BITS_A_WORD, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 29  # of the bitmap: 64 MB at most; beyond 8 million words more candidates pass it
SLICE_BITS = 1 << 16  # of the bitmap that are put together at once
HELD_CANDIDATES = 1 << 21  # of a task at a time

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse and a word's rest can be moved by one place
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def counted_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", one_in: int = TYPO_ONE_IN) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z in lower case, and how often each occurs. Where one_in divides the crc32 of
    `<key>:<run>`, the run has lost one code point. A null text has no runs; a null key is written as an empty one."""
    run = F.col("run")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
    at = F.pmod(F.col("h"), F.length(run)).cast("int")
    word = F.when(F.col("h") % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)
    return runs.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _scrambled(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) & np.uint64(bits - 1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hashed(words: np.ndarray) -> np.ndarray:
    """One hash for each row of code points, all of one length."""
    return (words * _powers(words.shape[1])).sum(axis=1, dtype=np.uint64)


def _by_length(words: list[bytes]):
    """Matrices of the code points of words of one length, in parts whose rows are held at once."""
    for length in sorted({len(w) for w in words}):
        mine = [w for w in words if len(w) == length]
        step = max(1, HELD_CANDIDATES // (length * 128))
        for at in range(0, len(mine), step):
            part = mine[at : at + step]
            yield np.frombuffer(b"".join(part), dtype=np.uint8).reshape(len(part), length).astype(np.uint64)


def _bitmap(words: DataFrame, bits: int) -> np.ndarray:
    """A bit for each word's hash. Tasks put them together to slices of bytes, which reach the driver one partition of them at a
    time and are no more than the bitmap's size; no row a word does."""

    def mark(batches):
        for batch in batches:
            found = [np.empty(0, dtype=np.uint64)] + [_scrambled(_hashed(w), bits) for w in _by_length([x.encode("latin-1") for x in batch.column(0).to_pylist()])]
            h = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array((h // np.uint64(SLICE_BITS)).astype(np.int32)), pa.array((h % np.uint64(SLICE_BITS)).astype(np.int32))], names=["slice", "bit"])

    def gather(marks: pa.Table) -> pa.Table:
        held = np.zeros(SLICE_BITS, dtype=bool)
        held[marks.column("bit").to_numpy()] = True
        return pa.table({"slice": pa.array([marks.column("slice")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    slices = words.select("word").mapInArrow(mark, "slice int, bit int").groupBy("slice").applyInArrow(gather, "slice int, bits binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in slices.toLocalIterator():
        out[r["slice"] * SLICE_BITS // 8 :][: SLICE_BITS // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.view("<u8")


def edits(words: np.ndarray, alphabet: np.ndarray, exists) -> list[tuple[np.ndarray, list[bytes]]]:
    """(rows, edited words) of the distinct words one edit away from each row of `words` (code points, one length) whose hash
    exists() takes; each is made once: in a run of equal letters the first is deleted, and a letter is not inserted behind its equal.
    """
    m, length = words.shape
    powers = _powers(length + 1)
    before = np.zeros((m, length + 1), dtype=np.uint64)
    np.cumsum(words * powers[:length], axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    spell = lambda rows, make: (rows, [make(*x) for x in rows])
    text = [bytes(w.astype(np.uint8)) for w in words]
    out = []

    new = np.ones((m, length), dtype=bool)
    new[:, 1:] = words[:, 1:] != words[:, :-1]
    hits = np.argwhere(new & exists(before[:, :-1] + (whole - before[:, 1:]) * _INVERSE))
    out.append((hits[:, 0], [text[r][:i] + text[r][i + 1 :] for r, i in hits.tolist()]))

    step = max(1, HELD_CANDIDATES // max(1, m * len(alphabet)))
    letters = [bytes([int(a)]) for a in alphabet]
    for at in range(0, length + 1, step):
        places = np.arange(at, min(length + 1, at + step))
        added = alphabet[None, None, :] * powers[places][None, :, None]
        kept = before[:, places]
        inserted = (kept + (whole - kept) * _P)[:, :, None] + added
        behind = np.concatenate([np.full((m, 1), 1 << 32, dtype=np.uint64), words], axis=1)[:, places]
        hits = np.argwhere((behind[:, :, None] != alphabet[None, None, :]) & exists(inserted))
        out.append((hits[:, 0], [text[r][: at + i] + letters[c] + text[r][at + i :] for r, i, c in hits.tolist()]))
        places = places[places < length]
        mine = words[:, places]
        replaced = (whole - mine * powers[places])[:, :, None] + added[:, : len(places)]
        hits = np.argwhere((mine[:, :, None] != alphabet[None, None, :]) & exists(replaced))
        out.append((hits[:, 0], [text[r][: at + i] + letters[c] + text[r][at + i + 1 :] for r, i, c in hits.tolist()]))
    return out


def neighbourhoods(words: DataFrame) -> DataFrame:
    """word, edited: of the words one edit away from each word, those that the bitmap of all words has; nearly all of them exist."""
    size = words.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_WORD * size - 1).bit_length() if size else LEAST_BITS))
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()  # 90 at most
    alphabet = np.array(sorted(ord(r.c) for r in letters), dtype=np.uint64)
    shared = words.sparkSession.sparkContext.broadcast(_bitmap(words, bits))

    def generate(batches):
        bitmap = shared.value

        def exists(h: np.ndarray) -> np.ndarray:
            h = _scrambled(h, bits)
            return (bitmap[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            for part in _by_length([w.encode("latin-1") for w in batch.column(0).to_pylist()]):
                text = [bytes(w.astype(np.uint8)).decode("latin-1") for w in part]
                for rows, edited in edits(part, alphabet, exists):
                    if edited:
                        yield pa.RecordBatch.from_arrays([pa.array([text[r] for r in rows.tolist()]), pa.array([e.decode("latin-1") for e in edited])], names=["word", "edited"])

    return words.select("word").mapInArrow(generate, "word string, edited string")


def _best(near: str, n: str) -> Column:
    return F.min_by(F.struct(F.col(near).alias("form"), F.col(n).alias("form_n")), F.struct(-F.col(n), F.col(near)))


def variants(vocabulary: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """vocabulary (word, n; distinct words of code points below 256) with n_near (its words one edit away), form (the commonest of
    these, of equals the first in code-point order, if it is `ratio` times as frequent), form_n and root (the last form of forms).

    A word without near words has none, no form, and is its own root; an empty vocabulary gives an empty table.

    Joins are by merging: Spark sizes what is generated from the vocabulary by the vocabulary's files, and would broadcast it.
    """
    vocabulary = cut(vocabulary.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    found = neighbourhoods(vocabulary).join(vocabulary.select(F.col("word").alias("edited"), F.col("n").alias("near_n")).hint("merge"), "edited")
    near = found.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), _best("edited", "near_n").alias("b"))
    frequent = F.col("b.form_n") >= ratio * F.col("n")
    words = vocabulary.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("b.form")).alias("form"), F.when(frequent, F.col("b.form_n")).alias("form_n")
    )
    words = cut(words, "spelling-forms")

    # A form is `ratio` times as frequent as its word, so the largest count bounds the length of the way to a root. Each round doubles the steps.
    most, least = words.agg(F.coalesce(F.max("n"), F.lit(1)), F.coalesce(F.min("n"), F.lit(1))).first()
    steps = int(math.log(max(1, most / max(1, least)), ratio)) + 1
    roots = cut(words.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward")).hint("merge")
        roots = cut(roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "spelling-roots")
    return words.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir):
    """Every word of at least 6 letters and 5 occurrences of all documents, with its near words' count, form and root.

    A null text has no words and a null doc_id is written as nothing before the colon; a repeated row counts again; very long
    words are handled in parts of their edits; no documents, or none with such words, give no rows."""
    words = counted_words(table(spark, sf_dir, "documents"))
    return variants(words.where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT)))


#: A byte for each letter beyond ASCII, as the engine's levenshtein counts bytes.
_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
_BYTES = "".join(map(chr, range(33, 97)))

OP11_SQL = rf"""
WITH RECURSIVE steps(i, k, c) AS (SELECT range, 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT i, c FROM steps WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
grouped AS (SELECT id, run, count(*) AS times, row_number() OVER () AS g FROM runs GROUP BY id, run),
hexed AS (SELECT g, hex(encode(id || ':' || run)) AS x FROM grouped),
crcs(g, x, pos, crc) AS (SELECT g, x, 0, CAST(4294967295 AS BIGINT) FROM hexed
  UNION ALL SELECT g, x, pos + 1, xor(crc >> 8, c) FROM crcs JOIN crc_table ON i = xor(crc & 255, 16 * strpos('0123456789ABCDEF', substr(x, 2 * pos + 1, 1)) + strpos('0123456789ABCDEF', substr(x, 2 * pos + 2, 1)) - 17) WHERE 2 * pos < length(x)),
hashes AS (SELECT g, xor(crc, 4294967295) AS h FROM crcs WHERE 2 * pos = length(x)),
edited AS (SELECT times, CASE WHEN h % {TYPO_ONE_IN} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM grouped JOIN hashes USING (g)),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n, translate(word, '{_ACCENTED}', '{_BYTES.replace("'", "''")}') AS b FROM edited WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM words x JOIN words y ON length(y.b) BETWEEN length(x.b) - 1 AND length(x.b) + 1 AND levenshtein(x.b, y.b) = 1),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * words.n THEN (SELECT min(other) FROM near WHERE near.word = words.word AND other_n = top) END AS form, CASE WHEN top >= {RATIO} * words.n THEN top END AS form_n FROM words LEFT JOIN best USING (word)),
way(word, reached, step) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT way.word, form, step + 1 FROM way JOIN forms ON forms.word = reached WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, step) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
