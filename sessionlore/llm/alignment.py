"""Alignment of two tokenizers over a corpus, by a dictionary of token groups.

A text is encoded by tokenizer A (byte-level BPE) and by tokenizer B (pieces with byte
fallback). Where tokens of both end at the same byte, the text is cut: each part holds
a group, the A ids and the B ids of the same bytes. A group's links are its pairs of
tokens with a byte in common; they follow from its ids alone, so they are worked out
once a distinct group and multiplied by how often it occurs:

1. ``chunks`` encodes documents and writes a row for some MB of text: the distinct
   groups in it with their frequencies, and each document as numbers of those groups.
2. ``interned`` sums the frequencies, numbers the distinct groups of the corpus, and
   expands each into links.
3. ``pair_counts`` sums links times frequencies for each id pair, and marks the pairs
   that no other pair of the same B id exceeds.
4. ``aligned`` gives each group its sums over links, joins them to the chunks by group,
   and adds them up for each document.

Neither documents nor their groups are shuffled one by one, and a group that is
frequent has one row a chunk. Only the largest count of each B id is broadcast: as many
rows as B has ids.

Neither tokenizer joins what stands before a space to it where no white space comes
before the space, so both encode such segments alone and a Python worker remembers
those it has met. A file of A with other rules, or a B with a piece that goes on after
a space, is a ValueError.

Null and empty texts, and those that B does not give back byte by byte, have no tokens:
zeros, and an empty digest. A text of any length is one document of one chunk. Repeated
rows and null keys stay, and every one of them counts. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_or_empty, written
from .tokens import splits_like_words, vocabulary_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
#: Spaces that do not begin a segment: after white space, at either end of a text.
ODD = re.compile(r"\s | $|^ ")
#: Segments in a worker's memory, and characters of those; it starts anew beyond either.
REMEMBERED, REMEMBERED_CHARS = 400_000, 32 << 20
#: Segments encoded at once have about so many characters.
BLOCK = 1 << 15
#: A chunk has about so many characters and at most so many documents.
CHUNK_CHARS, CHUNK_ROWS = 4 << 20, 4096


def segments(text: str) -> list[str]:
    """The parts, without the space before each, that both tokenizers encode alone."""
    parts = text.split(" ")
    if not ODD.search(text):
        return parts
    out = parts[:1]
    for i, part in enumerate(parts[1:], 2):
        if not out[-1] or out[-1][-1].isspace() or (not part and i == len(parts)):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def links(a: list[int], b: list[int], a_widths: list[int], b_widths: list[int]) -> list[tuple[int, int]]:
    """The pairs of a group's tokens that have bytes in common."""
    out, i, j = [(a[0], b[0])], 0, 0
    ends = [a_widths[a[0]], b_widths[b[0]]]
    while i < len(a) - 1 or j < len(b) - 1:
        if ends[0] < ends[1]:
            i += 1
            ends[0] += a_widths[a[i]]
        else:
            j += 1
            ends[1] += b_widths[b[j]]
        out.append((a[i], b[j]))
    return out


class Aligner:
    """Both tokenizers, and what a worker remembers of segments and groups."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if not splits_like_words(self.a) or any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("tokens may go on after a space")
        # In a byte-level vocabulary each character of a token stands for a byte.
        self.a_widths = np.array([len(self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())])
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.b_widths = np.array(list(map(len, self.b_bytes)))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.texts: list[str] = []  # of each segment: its groups
        self.bad: set[int] = set()  # segments that B does not give back
        self.sizes = array("i")  # of each segment: A tokens, B tokens, groups
        self.groups = array("i")  # of all segments, one after another
        self.numbers: dict[str, int] = {}  # of groups

    def learn(self, unmet: Iterable[str]) -> None:
        block, size = [], 0
        for segment in unmet:
            if not segment or segment[-1].isspace():  # nothing may follow it
                self._learn([segment])
                continue
            block.append(segment)
            size += len(segment)
            if size > BLOCK:
                self._learn(block)
                block, size = [], 0
        if block:
            self._learn(block)

    def _learn(self, block: list[str]) -> None:
        text = " ".join(["", *block])
        raw = text.encode()
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:], num_threads=1)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            if len(block) == 1:
                self.bad.add(len(self.texts))
                self._remember(block[0], "", 0, 0, [])
            for segment in block if len(block) > 1 else ():
                self._learn([segment])
            return
        a_ends, b_ends = np.cumsum(self.a_widths[a]), np.cumsum(self.b_widths[b])
        if a_ends[-1] != len(raw):
            raise ValueError("tokens of A do not cover a text")
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_cuts, b_cuts = (np.searchsorted(ends, both) + 1 for ends in (a_ends, b_ends))
        ends = np.cumsum([len(s.encode()) + 1 for s in block])
        last = np.searchsorted(both, ends)
        if not np.array_equal(both[last], ends):
            raise ValueError("tokens do not end with segments")
        a_text, b_text = list(map(str, a)), list(map(str, b))
        named, x, y = [], 0, 0
        for p, q in zip(a_cuts.tolist(), b_cuts.tolist()):
            named.append(f"{a_text[x] if p == x + 1 else ','.join(a_text[x:p])}|{b_text[y] if q == y + 1 else ','.join(b_text[y:q])}")
            x, y = p, q
        first, x, y = 0, 0, 0
        for segment, end in zip(block, (last + 1).tolist()):
            p, q = int(a_cuts[end - 1]), int(b_cuts[end - 1])
            self._remember(segment, ";".join(named[first:end]), p - x, q - y, named[first:end])
            first, x, y = end, p, q

    def _remember(self, segment: str, text: str, n_a: int, n_b: int, named: list[str]) -> None:
        self.known[segment] = len(self.texts)
        self.chars += len(segment)
        self.texts.append(text)
        self.sizes.extend((n_a, n_b, len(named)))
        numbers = self.numbers
        self.groups.extend([numbers.setdefault(g, len(numbers)) for g in named])

    def read(self, texts: list[str | None]) -> list[list[int]]:
        """For each text the numbers of its segments; none where it has no tokens."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        parts = [segments(t) if t and SPACE not in t else [] for t in texts]
        self.learn(dict.fromkeys(s for s in chain.from_iterable(parts) if s not in self.known))
        out = [list(map(self.known.__getitem__, own)) for own in parts]
        return out if not self.bad else [own if self.bad.isdisjoint(own) else [] for own in out]

    def digest(self, own: list[int]) -> str:
        return hashlib.sha256(";".join(map(self.texts.__getitem__, own)).encode()).hexdigest() if own else ""


_made: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker and pair of files."""
    if (a_path, b_path) not in _made:
        _made[a_path, b_path] = Aligner(a_path, b_path)
    return _made[a_path, b_path]


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))


def _chunk(made: Aligner, chunk: int, keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    """One row: the distinct groups of some documents, and the documents."""
    own = made.read(texts)
    segment = np.fromiter(chain.from_iterable(own), np.int64)
    doc = np.repeat(np.arange(len(own)), list(map(len, own)))
    sizes = np.array(made.sizes, np.int64).reshape(-1, 3)
    starts = np.cumsum(sizes[:, 2]) - sizes[:, 2]
    n_a, n_b, n_groups = (np.bincount(doc, sizes[segment, k], len(own)).astype(np.int64) for k in range(3))
    lengths = sizes[segment, 2]
    ends = np.cumsum(lengths)
    group = np.array(made.groups, np.int64)[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[segment] - ends + lengths, lengths)]
    times = np.bincount(group, minlength=len(made.numbers))
    used = np.flatnonzero(times)
    place = np.cumsum(times > 0) - 1
    cells, counts = np.unique(np.repeat(doc, lengths) * (len(used) or 1) + place[group], return_counts=True)
    in_doc = np.cumsum(np.bincount(cells // (len(used) or 1), minlength=len(own)))
    documents = pa.StructArray.from_arrays(
        [
            keys, *(pa.array(x) for x in (n_a, n_b, n_groups, n_a + n_b - n_groups)), pa.array(map(made.digest, own), pa.string()),
            _lists(in_doc, (cells % (len(used) or 1)).astype(np.int32)), _lists(in_doc, counts.astype(np.int32)),
        ],
        names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "counts"],
    )
    names = list(made.numbers)
    groups = pa.StructArray.from_arrays([pa.array([names[i] for i in used], pa.string()), pa.array(times[used])], names=["ids", "times"])
    row = [pa.array([chunk], pa.int64()), _lists([len(used)], groups), _lists([len(own)], documents)]
    return pa.RecordBatch.from_arrays(row, names=["chunk", "groups", "documents"])


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or vocabulary_path(A_FILE), b_path or vocabulary_path(B_FILE)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(chunk, groups, documents), written; see the module's text."""
    files = _paths(a_path, b_path)
    rows = text_or_empty(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    kind = rows.schema["key"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, chunk = aligner(*files), TaskContext.get().partitionId() << 32
        keys, texts, size = [], [], 0
        for batch in batches:
            for piece in slices(batch, 1):
                keys.append(piece.column(0))
                own = piece.column(1).to_pylist()
                texts += own
                size += sum(map(len, own))
                if size >= CHUNK_CHARS or len(texts) >= CHUNK_ROWS:
                    yield _chunk(made, chunk, pa.concat_arrays(keys), texts)
                    keys, texts, size, chunk = [], [], 0, chunk + 1
        if texts:
            yield _chunk(made, chunk, pa.concat_arrays(keys), texts)

    document = f"key:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,places:array<int>,counts:array<int>"
    made = rows.mapInArrow(encode, f"chunk long, groups array<struct<ids:string,times:bigint>>, documents array<struct<{document}>>")
    return written(made, "alignment-chunks")


def interned(made: DataFrame, a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct groups of all chunks (id, ids, times), and their links (id, times, a, b, n), both written."""
    files = _paths(a_path, b_path)
    each = made.select(F.explode("groups").alias("g")).groupBy(F.col("g.ids").alias("ids")).agg(F.sum("g.times").alias("times"))
    dictionary = written(each.select(F.monotonically_increasing_id().alias("id"), "ids", "times"), "alignment-groups")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*files)
        a_widths, b_widths = own.a_widths.tolist(), own.b_widths.tolist()
        for batch in batches:
            pairs = []
            for ids in batch.column(1).to_pylist():
                a, b = ([int(x) for x in side.split(",")] for side in ids.split("|"))
                pairs.append(links(a, b, a_widths, b_widths))
            n = np.array([len(p) for p in pairs], np.int64)
            flat = np.array(list(chain.from_iterable(pairs)), np.int32).reshape(-1, 2)
            ids, times = (np.repeat(batch.column(k).to_numpy(), n) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, times, flat[:, 0], flat[:, 1])], names=["id", "times", "a", "b"])

    expanded = dictionary.mapInArrow(expand, "id long, times long, a int, b int")
    return dictionary, written(expanded, "alignment-links")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links of the corpus hold each id pair, and whether no other A id has more with its B id."""
    counts = linked.groupBy("a", "b").agg(F.sum("times").alias("count"))
    counts = written(counts, "alignment-pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of B
    return counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    made = chunks(docs, key, text, a_path, b_path)
    dictionary, linked = interned(made, a_path, b_path)
    sums = linked.join(pair_counts(linked), ["a", "b"]).groupBy("id").agg(F.count_if("best").alias("best"), F.sum("count").alias("count"))
    per_group = dictionary.join(sums, "id").select("ids", "best", "count")
    held = made.select("chunk", F.posexplode("groups").alias("place", "g")).select("chunk", "place", F.col("g.ids").alias("ids"))
    cells = held.join(per_group, "ids").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", "best", "count"))).alias("s"))  # of one chunk
    sides = cells.select("chunk", F.col("s.best").alias("best"), F.col("s.count").alias("count"))
    both = made.select("chunk", "documents").join(sides, "chunk", "left")

    def summed(d, values: str):
        each = F.zip_with(d["places"], d["counts"], lambda place, n: F.get(F.col(values), place) * n)
        return F.aggregate(each, F.lit(0).cast("long"), lambda total, x: total + x)

    plain = ("n_a", "n_b", "n_groups", "n_links")
    row = lambda d: F.struct(d["key"].alias(key), *(d[c].alias(c) for c in plain), summed(d, "best").alias("n_best"), summed(d, "count").alias("count_sum"), d["groups_sha256"].alias("groups_sha256"))
    return both.select(F.inline(F.transform("documents", row)))


def token_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(key, groups): each row's groups as text, ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    files = _paths(a_path, b_path)
    rows = text_or_empty(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(*files)
        for batch in batches:
            for piece in slices(batch, 1):
                named = [";".join(map(made.texts.__getitem__, own)) for own in made.read(piece.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(named, pa.string())], names=["key", "groups"])

    return rows.mapInArrow(name, f"key {rows.schema['key'].dataType.simpleString()}, groups string").withColumnRenamed("key", key)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, groups and links by both tokenizers."""
    return aligned(table(spark, sf_dir, "documents"))


QUERIES = {"op12_alignment": op12_alignment}
ORACLE: dict[str, str] = {}
