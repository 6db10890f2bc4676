"""Substring deduplication by content-defined chunks.

A gear hash rolls over the last 16 bytes of a text's UTF-8 form; a chunk ends
where it falls below a bound, so cuts follow the content and an insertion moves
none but its neighbours. A cut with another candidate within the ``LEAST``
bytes before it is dropped and a chunk longer than ``MOST`` is divided from its
start, both by rules that look at nearby bytes only. Chunks are told apart by a
64-bit digest.

Single short chunks repeat by chance or as common lines, so the unit that is
compared is a window: from each chunk on, and back from each chunk, the fewest
adjacent chunks of at least ``passage`` characters. Windows cover exactly the
runs of at least so many characters: two documents share that many characters of adjacent
chunks exactly if they share a window, so the smallest document that holds a
window is the smallest that shares a passage there. It keeps the window; windows
of one document that overlap and have the same keeper form one passage. Nothing
shorter than ``passage`` is ever cut. A kept passage can overlap one that an
earlier document keeps; the overlap is cut with the latter. A shared passage
loses the parts before its first and after its last cut, two chunks on average,
so the bound lies well below the passages to be found.

Digests are aggregated in each task before they are shuffled, and the join that
brings positions back can split a digest shared by very many documents. Whole
texts are chunked. Documents are told apart by doc_id: repeated rows of one id
never make a window repeated. Rows with a null id, and null or empty texts, have
no spans. An empty table gives an empty result; ``remove`` keeps all columns,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written

#: A 32-bit value for each byte, from a digest of that byte.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)
WINDOW = 16
EVERY = 18
LEAST, MOST = 4, 160
PASSAGE = 125


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of UTF-8 bytes; the last one is the end of the data."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    held = GEAR[data]
    shift = 1
    while shift < WINDOW:
        after = held.copy()
        after[shift:] += held[:-shift] << np.uint32(shift)
        held, shift = after, 2 * shift
    ends = np.flatnonzero((held >> np.uint32(16)) < 65536 // EVERY) + 1
    ends = ends[ends < n]
    ends = ends[(data[ends] & 0xC0) != 0x80]  # between characters
    ends = np.append(ends[np.diff(ends, prepend=-LEAST - 1) > LEAST], n)
    starts = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - starts > MOST)
    if len(long):
        more = np.concatenate([np.arange(starts[i] + MOST, ends[i], MOST) for i in long])
        while len(inside := np.flatnonzero((data[more] & 0xC0) == 0x80)):
            more[inside] -= 1
        ends = np.unique(np.concatenate([ends, more]))
    return ends


def chunks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(digests, ends in characters) of a text's chunks."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    ends = cuts(data)
    at = ends.tolist()
    view = memoryview(raw)
    digest = xxhash.xxh3_64_intdigest
    digests = np.array([digest(view[a:b]) for a, b in zip([0, *at[:-1]], at)], np.uint64).view(np.int64)
    if len(raw) != len(text):
        ends = np.cumsum((data & 0xC0) != 0x80)[ends - 1]
    return digests, ends


#: Odd, so that it has an inverse among 64-bit numbers.
BASE = 0x9E3779B97F4A7C15


def windows(text: str, passage: int) -> tuple[np.ndarray, ...]:
    """(digests, first chunks, last chunks, starts, ends in characters) of a text's windows.

    A window's digest is a polynomial in the digests of its chunks, from running sums.
    """
    digests, ends = chunks(text)
    starts = np.concatenate([np.zeros(1, ends.dtype), ends[:-1]])
    n = len(ends)
    ahead = np.searchsorted(ends, starts + passage)
    back = np.searchsorted(starts, ends - passage, "right") - 1
    first = np.flatnonzero(ahead < n)
    last = np.flatnonzero(back >= 0)
    last = last[ahead[back[last]] != last]  # the others are windows ahead
    first, last = np.concatenate([first, back[last]]), np.concatenate([ahead[first], last])
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digests.view(np.uint64) * np.cumprod(up))])
    made = (sums[last + 1] - sums[first]) * np.cumprod(down)[first]
    return made.view(np.int64), first, last, starts[first], ends[last]


WINDOW_SCHEMA = "doc_id long, text_print long, digests array<long>, firsts array<int>, lasts array<int>, starts array<int>, ends array<int>"


def windowed(docs: DataFrame, passage: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_print, digest, at, last, start, end), a row for each window; at and last are its chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                some = batch.slice(first, 512)
                made = [windows(t, passage) for t in some.column(2).to_pylist()]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(m[0]) for m in made])]), pa.int32())
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([m[i] for m in made]), kind)) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *lists], names=["doc_id", "text_print", "digests", "firsts", "lasts", "starts", "ends"])

    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text <> ''")
    rows = own.select("doc_id", F.xxhash64("text").alias("text_print"), "text").mapInArrow(cut, WINDOW_SCHEMA)
    zipped = F.explode(F.arrays_zip("digests", "firsts", "lasts", "starts", "ends")).alias("c")
    return rows.select("doc_id", "text_print", zipped).select("doc_id", "text_print", F.col("c.digests").alias("digest"), F.col("c.firsts").alias("at"), F.col("c.lasts").alias("last"), F.col("c.starts").alias("start"), F.col("c.ends").alias("end"))


SPAN_SCHEMA = "doc_id long, text_print long, start int, end int, chunks int, first_doc long, kept boolean"


def repeats(docs: DataFrame, passage: int = PASSAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated passages: (doc_id, text_print, start, end, chunks, first_doc, kept).

    A row is a passage of one keeper: ``first_doc``, the smallest document that
    holds its windows. ``kept`` is whether that is the document itself; else the
    row is a part that it loses. Passages of different keepers can overlap.
    """
    shared = windowed(docs, passage, key, text).groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").select("digest", "first_doc")
    shared = written(shared, "window-digests")
    met = windowed(docs, passage, key, text).join(shared, "digest")
    # A document's windows come together: as much as its own text.
    own = met.groupBy("doc_id", "text_print").agg(F.collect_set(F.struct("at", "last", "start", "end", "first_doc")).alias("met"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, print_, found in zip(*(c.to_pylist() for c in batch.columns)):
                found.sort(key=lambda w: (w["at"], w["last"]))
                latest: dict[int, dict] = {}
                made = []
                for w in found:
                    run = latest.get(w["first_doc"])
                    if run and w["at"] <= run["last"]:
                        run["last"], run["end"] = max(run["last"], w["last"]), max(run["end"], w["end"])
                    else:
                        latest[w["first_doc"]] = w
                        made.append(w)
                rows += [(doc, print_, w["start"], w["end"], w["last"] + 1 - w["at"], w["first_doc"], w["first_doc"] == doc) for w in made]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            names = ["doc_id", "text_print", "start", "end", "chunks", "first_doc", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return own.mapInArrow(runs, SPAN_SCHEMA)


def remove(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """``docs`` without the passages that an earlier document keeps."""
    spans = repeats(docs, passage).where("not kept").groupBy("doc_id", "text_print").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_print"))
    both = rows.join(spans, ["doc_id", "text_print"], "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    text = F.col("row.text")
    cut = F.aggregate("spans", start, lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))).alias("text")), lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.length(text))))
    return both.withColumn("cut", F.when(F.col("spans").isNotNull(), cut).otherwise(text)).select(*(F.col("cut").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that documents share, a row for each keeper: what a document keeps and what it loses to whom."""
    return repeats(table(spark, sf_dir, "documents")).drop("text_print")


QUERIES = {"op1_substrings": op1_substrings}
ORACLE: dict[str, str] = {}
