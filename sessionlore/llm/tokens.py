"""Token ids of whole texts by the tokenizers library, batch by batch.

Byte-level BPE splits a text into words by a fixed pattern and encodes each word
alone, so a word's ids never depend on its neighbours. ``Encoder`` uses that: it
splits texts whose characters all lie in the range where the standard library's
classes agree with the tokenizer's, by arrays over their characters, has the
tokenizer encode only words it has not met, and joins their ids. Every other text goes to the tokenizer whole, and
so does one that holds the content of an added token, which the tokenizer takes
out before it splits words. A file with another normalizer or splitting rule than
the one that WORDS states has all texts encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Characters for which WORDS splits exactly as the tokenizer does.
FOREIGN = re.compile("[^\t\n\r -~¡-ɏ]")
#: The same below 128, for bytes: what is left of a text without them is foreign.
PLAIN = bytes([9, 10, 13, *range(32, 127)])
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼½¾"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
SPACE, LETTER, NUMBER, OTHER = range(4)
#: The class of each character that is not foreign.
KINDS = np.array([SPACE if c.isspace() else LETTER if re.match(f"[{LETTERS}]", c) else NUMBER if re.match(f"[{NUMBERS}]", c) else OTHER for c in map(chr, range(0x250))], np.uint8)
#: What WORDS takes off after an apostrophe, by its first and, of two letters, its second.
ENDINGS = (("s", ""), ("t", ""), ("r", "e"), ("v", "e"), ("m", ""), ("l", "l"), ("d", ""))
#: Words in the newer of two generations that a Python worker remembers. When it is
#: full, it becomes the older one, and words met again move over.
GENERATION = 300_000
#: Characters of texts whose words are looked up together, or a single longer text.
GROUP = 1 << 20


def word_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the words of joined texts begin, as WORDS divides each; ``points`` are the code points
    of the texts, none of them foreign, and ``starts`` the places where texts begin."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = KINDS[points]
    edge = np.zeros(n + 2, bool)
    edge[starts] = edge[n:] = True
    new = edge[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    # The last white space before a word stands alone, but a space goes to the word.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
    new[last] = True
    new[last[points[last] == ord(" ")] + 1] = False
    quotes = np.flatnonzero((points == ord("'")) & new)
    quotes = quotes[~edge[quotes + 1]]
    one = points[quotes + 1]
    two = np.where(edge[quotes + 2], 0, points[np.minimum(quotes + 2, n - 1)])
    for first, second in ENDINGS:
        at = quotes[(one == ord(first)) & ((two == ord(second)) if second else True)]
        new[at + 1] = False
        ends = at + 2 + len(second)
        new[ends[ends < n]] = True
    return np.flatnonzero(new)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splits_like_words(tokenizer) -> bool:
    """Whether words can be encoded one by one: byte-level BPE that splits by WORDS and changes nothing before."""
    told = json.loads(tokenizer.to_str())
    splitter = told["pre_tokenizer"] or {}
    rule = (splitter.get("type"), splitter.get("add_prefix_space"), splitter.get("use_regex", True))
    model = told["model"]
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    return rule == ("ByteLevel", False, True) and plain and not (told["normalizer"] or told["truncation"] or told["padding"])


class Words:
    """Words with their ids, which lie one after another."""

    def __init__(self, dtype: np.dtype):
        self.at: dict[str, int] = {}
        self.flat, self.ends = np.empty(1 << 12, dtype), np.zeros(1 << 12, np.int64)

    def __len__(self) -> int:
        return len(self.at)

    def places(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 where it is not known."""
        return np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))

    def add(self, words: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        """New words, how many ids each has, and these."""
        n, end = len(self.at), int(self.ends[len(self.at)])
        if n + len(words) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(n + len(words), np.int64)])
        if end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(end + len(ids), self.flat.dtype)])
        self.at.update(zip(words, range(n, n + len(words))))
        self.flat[end : end + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(words)] = end + np.cumsum(counts)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids the words of these numbers have, and all of them joined."""
        first = self.ends[places]
        counts = self.ends[places + 1] - first
        ends = np.cumsum(counts)
        return counts, self.flat[np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    def __init__(self, path: str, remembered: int = GENERATION):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = sorted(added)
        self.by_words = splits_like_words(self.tokenizer)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # In a byte-level vocabulary each character of a token stands for a byte.
        size = self.tokenizer.get_vocab_size()
        self.widths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.known, self.older = Words(self.dtype), Words(self.dtype)

    def _pack(self, words: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        unmet = list(words)
        if len(self.older):
            places = self.older.places(unmet)
            again = np.flatnonzero(places >= 0)
            self.known.add([unmet[i] for i in again.tolist()], *self.older.ids(places[again]))
            unmet = [unmet[i] for i in np.flatnonzero(places < 0).tolist()]
        # After a space a word never joins the one before, so these are encoded as one text.
        others = [w for w in unmet if w[0] != " " or w.isspace()]
        alone = set(others)
        self._add_spaced([w for w in unmet if w not in alone])
        packed = self._pack(others)
        counts = np.array([len(ids) for ids in packed], np.int64) // self.dtype.itemsize
        self.known.add(others, counts, np.frombuffer(b"".join(packed), self.dtype))

    def _add_spaced(self, words: list[str]) -> None:
        """Words with the ids of each, cut from those of all by the bytes that tokens stand for."""
        if not words:
            return
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        reached = np.cumsum(self.widths[ids])
        ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in words])
        cuts = np.searchsorted(reached, ends) + 1
        if not (reached[cuts - 1] == ends).all():
            raise ValueError("tokens do not end with words")
        self.known.add(words, np.diff(cuts, prepend=0), ids)

    def _whole(self, text: str) -> bool:
        """Whether a text goes to the tokenizer as it is."""
        if not self.by_words or any(a in text for a in self.added):
            return True
        return bool(text.encode().translate(None, PLAIN)) if text.isascii() else FOREIGN.search(text) is not None

    def _joined(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, none of them whole, by the different words of all of them."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.cumsum([0] + [len(x) for x in texts])
        begins = word_starts(points, starts[:-1])
        places = np.append(begins, len(points))
        if not joined.isascii():  # in UTF-8, where the others take two bytes
            places = places + np.concatenate([[0], np.cumsum(points >= 128)])[places]
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(joined.encode())).dictionary_encode()
        own = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = self.known.places(own)
        unmet = np.flatnonzero(places < 0)
        if len(unmet):
            new = [own[i] for i in unmet.tolist()]
            self._learn(set(new))
            places[unmet] = self.known.places(new)
        counts, ids = self.known.ids(places[words.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(counts)])
        cuts = ends[np.searchsorted(begins, starts)].tolist()
        return (ids[a:b] for a, b in zip(cuts, cuts[1:]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as an array of the smallest fitting type."""
        out: list[np.ndarray | None] = [None] * len(texts)
        whole = [i for i, x in enumerate(texts) if self._whole(x)]
        for i, ids in zip(whole, self._pack([texts[i] for i in whole])):
            out[i] = np.frombuffer(ids, self.dtype)
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, Words(self.dtype)
        rest = [i for i in range(len(texts)) if out[i] is None]
        begin = 0
        while begin < len(rest):
            end, size = begin + 1, len(texts[rest[begin]])
            while end < len(rest) and size + len(texts[rest[end]]) <= GROUP:
                size += len(texts[rest[end]])
                end += 1
            group = rest[begin:end]
            for i, ids in zip(group, self._joined([texts[i] for i in group])):
                out[i] = ids
            begin = end
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remembered: int = GENERATION) -> Encoder:
    """One encoder for each Python worker, vocabulary file and size of its memory."""
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = Encoder(path, remembered)
    return _encoders[path, remembered]
