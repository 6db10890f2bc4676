"""Byte-pair encoding of whole texts by merge ranks, and decoding.

A text is cut at the vocabulary's added tokens, the rest is normalised and split
into words, and each word's symbols are merged: a priority queue holds the ranks of
neighbouring pairs, the symbols form a doubly linked list, and an entry whose pair
has changed since it was pushed is skipped. A word's ids never depend on its
neighbours, so a Python worker remembers those of words it has met. Decoding
concatenates the vocabulary's strings, with a space between two of them as the
tokenizers library puts it where a file names no decoder.

Words of texts in the range where the standard library's classes agree with the
tokenizer's are found by a pattern; other texts are normalised and split by the
tokenizer file's own rules. Files with a BPE model without dropout, unknown token
and byte fallback are supported, others are a ValueError.

A null or empty text, or one of white space, has no ids and decodes to an empty
text. A text of any length is encoded whole; one word of n symbols takes n log n
steps. Repeated rows and null keys stay; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_or_empty
from .tokens import FOREIGN, LETTERS, NUMBERS, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
#: How the file of VOCABULARY normalises and splits, so that a pattern can do the same.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: Words in the newer of two generations that a worker remembers.
GENERATION = 300_000


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones
    for themselves, the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + rest.index(b)) for b in range(256)]


#: Pairs and queue entries are whole numbers: two ids, or a rank and a place.
SHIFT, PLACE = 32, (1 << 32) - 1
#: In the place of a symbol that was merged into the one before.
GONE = -1


def merged(symbols: list[int], ranks: dict[int, int], wholes: list[int]) -> list[int]:
    """The ids left when the pair of the lowest rank, the first of equal ones, is merged
    until no pair has a rank. ``ranks`` has the rank of ``a << SHIFT | b``, ``wholes`` what
    a rank makes. An entry of the queue names a pair by its right symbol's place."""
    n, rank_of = len(symbols), ranks.get
    queue = [rank << SHIFT | right for right, (a, b) in enumerate(zip(symbols, symbols[1:]), 1) if (rank := rank_of(a << SHIFT | b)) is not None]
    if not queue:
        return symbols
    heapify(queue)
    before, after = list(range(-1, n)), list(range(1, n + 1))
    while queue:
        entry = heappop(queue)
        rank, right = entry >> SHIFT, entry & PLACE
        left = before[right]
        if symbols[right] == GONE or rank_of(symbols[left] << SHIFT | symbols[right]) != rank:
            continue  # stale: a symbol of the pair was merged meanwhile
        symbols[left], symbols[right] = whole, _ = wholes[rank], GONE
        after[left] = right = after[right]
        if right < n:
            before[right] = left
            if (rank := rank_of(whole << SHIFT | symbols[right])) is not None:
                heappush(queue, rank << SHIFT | right)
        first = before[left]
        if first >= 0 and (rank := rank_of(symbols[first] << SHIFT | whole)) is not None:
            heappush(queue, rank << SHIFT | left)
    return [s for s in symbols if s != GONE]


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, remembered: int = GENERATION):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        model = told["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "continuing_subword_prefix", "ignore_merges")) or told["decoder"]:
            raise ValueError(f"unsupported model or decoder: {path}")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.ranks = {self.vocabulary[a] << SHIFT | self.vocabulary[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.wholes = [self.vocabulary[a + b] for a, b in pairs]
        strings = {i: s for s, i in (self.vocabulary | self.added).items()}
        self.strings = pa.array([strings.get(i) for i in range(max(strings) + 1)])
        steps = (told["normalizer"] or {}).get("normalizers", [])
        splits = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_pattern = [s["type"] for s in steps] == NORMALIZER and splits[0].get("pattern") == {"Regex": SPLIT}
        self.cut = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True))) if self.added else None
        self.characters = byte_characters()
        self.bytes = {c: b for b, c in enumerate(self.characters)}
        self.inner = [self.vocabulary[c] for c in self.characters]
        self.last = [self.vocabulary[c + self.suffix] for c in self.characters]
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word_ids(self, word: str) -> list[int]:
        """Ids of one normalised word."""
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return merged(symbols, self.ranks, self.wholes)

    def decode(self, ids: list[bytes]) -> pa.Array:
        """For each list of ids the vocabulary's strings, one after another."""
        ends = np.cumsum([0, *(len(own) // 4 for own in ids)])
        strings = self.strings.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings), " ")

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without added tokens."""
        if self.by_pattern and not FOREIGN.search(text):
            return WORDS.findall(text.lower())
        plain = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]

    def _section(self, text: str) -> bytes:
        words = self.words(text)
        parts = list(map(self.known.get, words))
        if None in parts:
            for i, word in enumerate(words):
                if parts[i] is None:
                    if (ids := self.known.get(word) or self.older.get(word)) is None:
                        ids = array("I", self.word_ids(word)).tobytes()
                    parts[i] = self.known[word] = ids
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, little-endian unsigned 32-bit."""
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        out, at = [], 0
        for found in self.cut.finditer(text) if self.cut else ():
            out += [self._section(text[at : found.start()]), array("I", [self.added[found.group()]]).tobytes()]
            at = found.end()
        return b"".join([*out, self._section(text[at:])])


_made: dict[str, Bpe] = {}


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids, decoded) of every row: ids as little-endian unsigned 32-bit integers."""
    path = vocabulary or vocabulary_path(VOCABULARY)
    rows = text_or_empty(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    kind = rows.schema["key"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _made:
            _made[path] = Bpe(path)
        own = _made[path]
        for batch in batches:
            for piece in slices(batch, 1):
                ids = [own.encode(t) for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.binary()), own.decode(ids)], names=["key", "ids", "decoded"])

    return rows.mapInArrow(encode, f"key {kind}, ids binary, decoded string").withColumnRenamed("key", key)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    rows = encoded(table(spark, sf_dir, "documents"))
    n = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op11_bpe": op11_bpe}
ORACLE: dict[str, str] = {}
