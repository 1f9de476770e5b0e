"""Best-fit packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import os
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, small_batches, table

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 16384  # pieces that one task packs; each group ends with about one part-filled sequence
CACHE = 120_000  # entries of each of an encoder's two caches

#: Words as the tokenizer's pre-tokenizer splits lower-case text. Fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: What a tokenizer's file has to say for its words to be split and joined here. Fixed values of the format.
SHAPE = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
    "patterns": [r"\s+", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"],
}
#: Characters for which splitting at spaces and lower-casing before encoding can't change the ids.
PLAIN = r"[\t-\r -~¡-įı-ňŊ-ž]*"

_encoders: dict[str, Encoder] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others in order from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def splits_words(path: str) -> bool:
    """Whether the file is of the kind that SHAPE describes, with no option on that would change ids."""
    import json

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    parts = lambda name, inner: (said[name] or {}).get(inner) or []
    normal, pre, model = parts("normalizer", "normalizers"), parts("pre_tokenizer", "pretokenizers"), said["model"]
    patterns = [p["pattern"].get("Regex") for p in (*normal, *pre) if "pattern" in p]
    return (
        {"normalizer": [x["type"] for x in normal], "pre_tokenizer": [x["type"] for x in pre], "patterns": patterns} == SHAPE
        and [p["content"] for p in normal if "content" in p] == [" "]
        and (pre[0]["behavior"], pre[0]["invert"], pre[1]["add_prefix_space"], pre[1]["use_regex"]) == ("Removed", True, False, False)
        and model["type"] == "BPE"
        and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and not (said["truncation"] or said["padding"])
        and all(t["content"].startswith("<|") for t in said["added_tokens"])
    )


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, without special tokens, equal to the tokenizer's own.

    Where the file is byte-level BPE that lower-cases and splits words by WORDS, texts of plain Latin characters are cut at
    spaces and line ends, and the ids of chunks and of words are remembered (up to CACHE of each); words not seen before go to
    the tokenizer's merges, and all other texts to the tokenizer. With a file of any other kind all texts go to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.splits = splits_words(path)
        self.find = regex.compile(WORDS).findall
        self.plain = regex.compile(PLAIN).fullmatch
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of one lower-case word: by the tokenizer's merges alone, as there is nothing left to normalise or to split."""
        spelt = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.merge(spelt)])
        if len(self.words) < CACHE:
            self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        out = b"".join([self.words.get(w) or self._word(w) for w in self.find(chunk.lower())])
        if len(self.chunks) < CACHE:
            self.chunks[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        if not self.splits or "<|" in text or not self.plain(text):
            return self._raw([text])[0]
        chunks = text.replace("\n", " ").split(" ")
        found = list(map(self.chunks.get, chunks))
        if None in found:
            for i in [i for i, ids in enumerate(found) if ids is None]:
                found[i] = self._chunk(chunks[i])
        return b"".join(found)


def tokenised_pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece of at most capacity ids: key, piece, start, length, ids_crc32 and, with_ids, the ids as binary. A null text is empty; every document ends with id 1."""
    schema = pa.schema([(key, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids])
    end = END_ID.to_bytes(4, "little")

    def encode(batches):
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            out = [[] for _ in schema]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        release()

    return small_batches(docs).select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(encode, f"{key} long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class RoomTree:
    """Segment tree over remaining capacities: a leaf counts the open bins with that much room, a node those below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> int:
        """The smallest room of at least need that an open bin has; -1 if there is none."""
        i, count = need + self.leaves, self.count
        while not count[i]:
            while i & 1:
                i >>= 1
            if not i:
                return -1
            i += 1
        while i < self.leaves:
            i *= 2
            if not count[i]:
                i += 1
        return i - self.leaves

    def take(self, room: int) -> int:
        i = room + self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.bins[room].pop()


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, by best-fit decreasing; lengths of equal size are taken in the order given."""
    tree, bins, offsets, opened = RoomTree(capacity), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room = tree.tightest(n) if n < capacity else -1
        if room < 0:
            bins[i], room = opened, capacity
            opened += 1
        else:
            bins[i] = tree.take(room)
        offsets[i] = capacity - room
        if room > n:
            tree.add(room - n, bins[i])
    return bins, offsets


def pack(pieces: DataFrame, *, length: str = "length", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces with sequence_id and offset (gapless from 0). Lengths are 1 to capacity.

    Pieces are dealt at random (by a row id, so repeated rows and hot keys spread) into groups that one task packs, so the
    work is linear and memory bounded; a group costs at most about one sequence more than packing everything together would.
    """
    pieces = pieces.drop("sequence_id", "offset", "pack_id")
    kept = cut(pieces.withColumn("pack_id", F.monotonically_increasing_id()), "pack-pieces")
    groups = max(1, -(-kept.count() // group_pieces))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pack_id")
        bins, offsets = best_fit(pdf["pack_length"].tolist(), capacity)
        return pd.DataFrame({"pack_id": pdf["pack_id"], "sequence_id": pdf["pack_group"] * (1 << 32) + bins, "offset": offsets})

    keyed = kept.select("pack_id", F.col(length).alias("pack_length"), F.pmod(F.xxhash64("pack_id"), F.lit(groups)).alias("pack_group"))
    placed = keyed.groupBy("pack_group").applyInPandas(fill, "pack_id long, sequence_id long, offset long")
    return kept.join(placed, "pack_id").drop("pack_id")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (binary, little-endian) of pieces packed with their ids; a group is one sequence's pieces, so it is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ordered.alias("parts")).select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece with its place; with_ids, with its token ids too (binary, little-endian unsigned 32-bit), so that `sequences` can be made of them."""
    packed = pack(tokenised_pieces(docs, tokenizer or tokenizer_path(), with_ids=with_ids))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def op7_best_fit_packing(spark, sf_dir):
    """All documents in sequences of at most 4096 tokens.

    A null text is empty, so its only id is the end; a null doc_id stays null; repeated rows are packed as often as they come;
    a longer document is cut into pieces of 4096; no documents give no rows."""
    return pack_documents(table(spark, sf_dir, "documents"))
