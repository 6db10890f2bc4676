"""Terms of messages and queries: lower-cased words without diacritics, and their stems."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower-case Latin letters with diacritics, and their base letters.
MARKED = "".join(c for c in map(chr, range(0xDF, 0x250)) if c.islower() and unicodedata.normalize("NFD", c) != c)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)
BREAKS = r"[^\p{L}\p{N}]+"
#: Constants of BM25.
K1, B = 1.2, 0.75
#: Postings lie in levels of their weight, which says how much of a message a word makes up.
#: A level's number counts messages of this many terms as of the mean length; a store has its own.
LEVELS, TYPICAL_TERMS = 64, 100.0


def words(text: Column) -> Column:
    """Terms in order. Letters with Latin diacritics count as their base letters."""
    folded = F.translate(F.lower(text), MARKED, PLAIN)
    return F.filter(F.split(folded, BREAKS), lambda w: w != "")


# The suffix stripping algorithm of M. F. Porter, "An algorithm for suffix stripping", Program 14 (1980).
_VOWELS = "aeiou"
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in _VOWELS or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _shape(word)[-2:] == "cc" and word[-1] == word[-2] and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for old, new in sorted(rules, key=lambda r: -len(r[0])):
            if word.endswith(old):
                if _measure(word[: -len(old)]) > 0:
                    word = word[: -len(old)] + new
                break
    for old in _STEP4:
        if word.endswith(old):
            base = word[: -len(old)]
            if _measure(base) > 1 and (old != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=200_000)
def known_stem(word: str) -> str:
    return stem(word)


def weight(tf: Column, terms: Column, mean: Column | float) -> Column:
    """BM25 of a hit but for factors that all hits of a query share: from 0 to 1."""
    return tf / (tf + K1 * (1 - B + B * terms / mean))


def level(tf: Column, terms: Column, typical: float) -> Column:
    return F.floor(weight(tf, terms, typical) * LEVELS).cast("int")


def most_below(low: int, typical: float, mean: float) -> float:
    """No weight of a level below ``low`` is larger, where ``mean`` has taken the place of ``typical``.

    A weight w is tf / (tf + c), so c / tf = (1 - w) / w; with another mean c changes by
    a factor between 1 and typical / mean.
    """
    edge = low / LEVELS
    return 0.0 if low <= 0 else 1 / (1 + min(1.0, typical / mean) * (1 - edge) / edge)


def sized(messages: DataFrame) -> DataFrame:
    """``messages`` with the number of their terms, those of the role included."""
    return messages.withColumn("terms", (F.size(words(F.col("role"))) + F.size(words(F.col("content")))).cast("long"))


def postings(messages: DataFrame, typical: float = TYPICAL_TERMS) -> DataFrame:
    """(stem, level, session_key, line_no, role, terms, in_role, in_content): where each stem
    stands in a message's role and in its content, each counted from 0."""
    own = messages.select("session_key", "line_no", "role", "terms", words(F.col("role")).alias("r"), words(F.col("content")).alias("c"))
    places = pa.list_(pa.int32())
    schema = pa.schema([("session_key", pa.int64()), ("line_no", pa.int64()), ("role", pa.string()), ("terms", pa.int64()), ("stem", pa.string()), ("in_role", places), ("in_content", places)])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                counts = [pc.fill_null(pc.list_value_length(piece.column(k)), 0).to_numpy() for k in (4, 5)]
                found = pa.concat_arrays([piece.column(k).flatten() for k in (4, 5)]).dictionary_encode()
                stems = pa.array([known_stem(w) for w in found.dictionary.to_pylist()], pa.string()).dictionary_encode()
                if not len(stems):
                    continue
                row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in counts])
                place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in counts])
                key = row * len(stems.dictionary) + stems.indices.to_numpy()[found.indices.to_numpy()]
                order = np.argsort(key, kind="stable")  # places of a stem stay in order, the role's first
                key, place, spoken = key[order], place[order].astype(np.int32), order >= counts[0].sum()
                first = np.flatnonzero(np.diff(key, prepend=-1))
                made = [stems.dictionary.take(pa.array(key[first] % len(stems.dictionary)))]
                for own_places in (~spoken, spoken):
                    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(own_places.astype(np.int32), first))]).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(place[own_places])))
                kept = piece.select(schema.names[:4]).take(pa.array(key[first] // len(stems.dictionary)))
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], schema=schema)

    rows = own.mapInArrow(listed, "session_key long, line_no long, role string, terms long, stem string, in_role array<int>, in_content array<int>")
    tf = (F.size("in_role") + F.size("in_content")).cast("double")
    return rows.select("stem", level(tf, F.col("terms"), typical).alias("level"), "session_key", "line_no", "role", "terms", "in_role", "in_content")
