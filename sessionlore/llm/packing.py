"""Packing token sequences by length patterns.

Every document becomes its token ids plus an end id, cut into pieces: full
windows, and one remainder shorter than the window. Only the histogram of
remainder lengths (fewer bins than the window has positions, whatever the
corpus) decides what goes together:

1. enumerate shallow combinations of up to three lengths whose sum fills the
   window up to ``slack`` ids;
2. solve how often each repeats as a non-negative least squares problem against
   the histogram, and round without using more pieces than there are;
3. pack what is left greedily: the longest piece with the longest ones that
   still fit, as often as the pieces last;
4. pieces that fit nowhere within the slack are cut into powers of two, which
   fill windows without a gap when dealt from long to short.

A piece's place follows from its rank among the pieces of its length, so the
rows meet the plan in one searchsorted over a table bounded by the window.
Ranks are counted within salted blocks of a length, which number grows with its
rows, and shifted by the blocks before, so one frequent length never lies in one
task.

The plan offers the solver all single lengths and pairs and an even choice of
triples, and packs rests from few pieces each; with more distinct lengths the
choice is thinner, which moves pieces between the steps but loses none. At
sf0.1 padding is 0.05 % of the ids, on a histogram with every length 0.15 %.

A null text is empty (its end id only). A text of any length is encoded whole and
cut into windows. Equal rows are packed as separate documents, and pieces that tie
in every column take either place; a null doc_id is kept as it is; an empty table
gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty
from .tokens import GENERATION, encoder, vocabulary_path

WINDOW = 2048
END_ID = 1
PIECE_SCHEMA = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, parts array<long>"
PLACED_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, remembered: int = GENERATION) -> DataFrame:
    """Full windows and remainders of every document; ``parts`` holds the
    checksums of a remainder's powers of two, from the largest."""
    vocabulary = vocabulary or vocabulary_path()
    powers = [1 << k for k in reversed(range((window - 1).bit_length()))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, remembered)
        last = np.array([end_id], "<u4")
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                rows = []
                for key, own in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    ids = memoryview(np.concatenate([own.astype("<u4"), last]).tobytes())
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        parts, at = [], start
                        if length < window:
                            for p in powers:
                                if length & p:
                                    parts.append(zlib.crc32(ids[4 * at : 4 * (at + p)]))
                                    at += p
                        rows.append((key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, parts))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts"])

    own = text_or_empty(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return own.mapInArrow(encode, PIECE_SCHEMA)


def combinations(present: np.ndarray, window: int, slack: int, most: int = 30_000) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window up to the slack.

    All single lengths and pairs; of the triples an even choice of up to
    ``most``, the sums nearest to the window first for each pair.
    """
    present = np.asarray(sorted(present), np.int64)
    exists = np.zeros(window + 1, bool)
    exists[present] = True
    rows = [np.stack([present[present >= window - slack], *[np.zeros((present >= window - slack).sum(), np.int64)] * 2], axis=1)]
    for gap in range(slack + 1):
        other = window - gap - present
        ok = (other > 0) & (other <= present)
        ok[ok] = exists[other[ok]]
        rows.append(np.stack([present[ok], other[ok], np.zeros(ok.sum(), np.int64)], axis=1))
    few = present[:: max(1, len(present) // int((6 * most) ** 0.5 + 1))]
    a, b = (x.ravel() for x in np.meshgrid(present, few, indexing="ij"))
    keep = (b <= a) & (a + b < window)
    a, b = a[keep], b[keep]
    room = window - a - b
    below = np.full(window + 1, -1)
    below[present] = present
    below = np.maximum.accumulate(below)
    c = below[room]
    ok = (c > 0) & (room - c <= slack) & (c <= b)
    triples = np.stack([a, b, c], axis=1)[ok]
    rows.append(triples[:: max(1, -(-len(triples) // most))])
    return np.unique(np.concatenate(rows), axis=0)


def least_squares(rows: np.ndarray, goal: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that bring their use nearest to the
    histogram: accelerated projected gradients on |A x - goal|^2."""
    bins = len(goal)
    flat = rows.ravel()
    use = lambda x: np.bincount(flat, np.repeat(x, rows.shape[1]), bins) * (np.arange(bins) > 0)
    back = lambda r: (r[rows] * (rows > 0)).sum(axis=1)
    step, v = 1.0, np.ones(len(rows))
    for _ in range(30):
        v = back(use(v / np.linalg.norm(v)))
    step = 1 / max(np.linalg.norm(v), 1e-9)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(0, y - step * back(use(y) - goal))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = after + (before - 1) / t * (after - x)
        x = after
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, slack: int = 8, depth: int = 12) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(patterns of lengths with their repeat counts, pieces left to be cut by length)."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    if len(present := np.flatnonzero(left)):
        rows = combinations(present, window, slack)
        if len(rows):
            solved = least_squares(rows, left.astype(float))
            for i in np.argsort(-solved, kind="stable"):
                own = [int(v) for v in rows[i] if v]
                n = min([int(solved[i] + 0.5), *(int(left[v]) // own.count(v) for v in own)])
                if n > 0:
                    patterns.append((tuple(own), n))
                    for v in own:
                        left[v] -= n
    rest: dict[int, int] = {}
    stock = np.flatnonzero(left).tolist()
    while stock:
        own, room, uses = [stock[-1]], window - stock[-1], {stock[-1]: 1}
        while room > slack and len(own) < depth:
            i = bisect_right(stock, room) - 1
            while i >= 0 and uses.get(stock[i], 0) >= left[stock[i]]:
                i -= 1
            if i < 0:
                break
            own.append(stock[i])
            uses[stock[i]] = uses.get(stock[i], 0) + 1
            room -= stock[i]
        if room > slack:
            rest[stock[-1]] = int(left[stock[-1]])
            left[stock.pop()] = 0
            continue
        n = min(int(left[v]) // k for v, k in uses.items())
        patterns.append((tuple(own), n))
        for v, k in uses.items():
            left[v] -= n * k
            if not left[v]:
                stock.remove(v)
    return patterns, rest


class Layout:
    """Where the piece of a length with a rank among its length goes."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW, slack: int = 8):
        self.window = window
        patterns, rest = plan(histogram, window, slack)
        self.first = np.zeros(window + 2, np.int64)  # of each length, in one long order of all pieces
        counts = np.zeros(window + 1, np.int64)
        for length, n in histogram.items():
            counts[length] = n
        self.first[1:] = np.cumsum(counts)
        taken = np.zeros(window + 1, np.int64)
        runs, sequence = [], 0
        for own, n in patterns:
            at = 0
            for length in own:
                runs.append((self.first[length] + taken[length], sequence, at))
                taken[length] += n
                at += length
            sequence += n
        self.taken = taken
        self.runs = np.array(sorted(runs) or [(0, 0, 0)], np.int64)
        self.whole = sequence
        # The cut pieces: for each power of two, how many come from shorter lengths and where its run of ids starts.
        self.bits = (window - 1).bit_length()
        left = counts - taken
        self.before = np.zeros((self.bits, window + 1), np.int64)
        at = 0
        self.base = np.zeros(self.bits, np.int64)
        for k in reversed(range(self.bits)):
            has = left * ((np.arange(window + 1) >> k) & 1)
            self.before[k] = np.cumsum(has) - has
            self.base[k] = at
            at += int(has.sum()) << k
        self.total = at

    def whole_place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[length] + rank
        run = self.runs[np.searchsorted(self.runs[:, 0], at, side="right") - 1]
        return run[:, 1] + at - run[:, 0], run[:, 2]

    def cut_place(self, k: int, length: int, rank: int) -> tuple[int, int]:
        """Of the part 2**k of a piece beyond the patterns. The last, partly filled
        window falls into sequences of powers of two, which need no padding."""
        at = int(self.base[k] + ((self.before[k, length] + rank - self.taken[length]) << k))
        sequence, offset = divmod(at, self.window)
        full = self.total // self.window
        if sequence == full:
            tail, start = self.total % self.window, 0
            for j in reversed(range(self.bits)):
                if tail >> j & 1:
                    if offset < start + (1 << j):
                        return self.whole + sequence, offset - start
                    start += 1 << j
                    sequence += 1
        return self.whole + sequence, offset


#: Blocks of each length, and the rows from which on there are more of them.
LEAST_BLOCKS, BLOCK_ROWS = 256, 10_000


def pack(
    docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, slack: int = 8, remembered: int = GENERATION
) -> DataFrame:
    """Every piece with its sequence and offset there; ``remembered`` trades a worker's memory for time."""
    made = cut(pieces(docs, vocabulary, window, end_id, remembered))
    # At most one row for each length up to the window.
    histogram = {r.length: r.n for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    layout = Layout(histogram, window, slack)
    dealing = [(length, max(LEAST_BLOCKS, -(-n // BLOCK_ROWS))) for length, n in histogram.items()]
    blocks = made.sparkSession.createDataFrame(dealing, "length int, blocks long")
    block = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("blocks")).alias("block")
    dealt = made.join(F.broadcast(blocks), "length").select(*made.columns, block)
    counts = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("block")
    shifts = counts.select("length", "block", (F.sum("n").over(earlier) - F.col("n")).alias("shift"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(shifts, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("shift"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(2).to_numpy(), batch.column(6).to_numpy()
            whole = rank < layout.taken[length]
            kept = batch.filter(pa.array(whole))
            sequence, offset = layout.whole_place(length[whole], rank[whole])
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), kept.column(2).cast(pa.int64()), kept.column(3), kept.column(4), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            rows = []
            for r in batch.filter(pa.array(~whole)).to_pylist():
                at = r["start"]
                powers = [k for k in reversed(range(layout.bits)) if r["length"] >> k & 1]
                for k, part in zip(powers, r["parts"], strict=True):
                    rows.append((r["doc_id"], at, 1 << k, part, r["doc_tokens"], *layout.cut_place(k, r["length"], r["rank"])))
                    at += 1 << k
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts", "rank").mapInArrow(place, PLACED_SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLE: dict[str, str] = {}
