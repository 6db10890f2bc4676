"""Token files: concatenated ids with Elias-Fano document boundaries.

``write_token_files`` deals documents into ranges of ascending doc_id, encodes
each whole text, and writes shards: one Parquet row holds one self-contained
binary shard of at most ``shard_ids`` ids (or one longer document). Writing
through Spark's committer keeps the files right when tasks are retried or
executors lost, on any file system Spark can write.

A shard's bytes, little-endian::

    magic "EFTK" | n_docs u32 | n_ids u64 | id width u8 | null doc_ids u32
    doc_ids: lowest i64, then an Elias-Fano list of the differences to it
    ends:    an Elias-Fano list of each document's end in the id array
    ids:     n_ids * width bytes
    crc32 of everything before, u32

An Elias-Fano list of n values below a universe u takes about 2 + log2(u / n)
bits a value: the low bits packed side by side, the high bits in unary, and the
bit position of every 256th one, from which ``select`` reaches any value, and
``run`` those up to the next sample, without a table of 64-bit offsets. A reader
takes all offsets from there.

A null or empty text has one end id only. A text of any length is encoded whole
and lies in one shard, which may then exceed ``shard_ids``. Rows with a null
doc_id come first; rows with equal doc_id follow by text, and repeated rows stay. An empty table writes no shard and reads
back as an empty result. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table, text_or_empty
from .tokens import encoder, vocabulary_path

END_ID = 2
SAMPLE = 256
#: Text that one task encodes.
PART_BYTES = 256 << 20
MAGIC = b"EFTK"
SHARD_SCHEMA = "part int, seq int, n_docs long, n_ids long, shard binary"


class EliasFano:
    """A non-decreasing list of whole numbers from 0 to ``universe``."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, universe = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sampled one before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)
        while word.bit_count() <= left:
            left -= word.bit_count()
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little") >> (first % 8) & ((1 << self.low_bits) - 1)
        return (one - i) << self.low_bits | low

    def run(self, first: int, count: int = SAMPLE) -> np.ndarray:
        """The values from the ``first``, the place of a sample, on: at most up to the next sample."""
        count = min(count, SAMPLE, self.n - first)
        block = first // SAMPLE
        begin = int(self.samples[block])
        end = int(self.samples[block + 1]) if block + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high[begin // 8 : -(-end // 8)], np.uint8), bitorder="little")
        ones = np.flatnonzero(bits[begin % 8 :])[:count] + begin
        out = (ones - np.arange(first, first + count)).astype(np.int64) << self.low_bits
        if self.low_bits:
            at = first * self.low_bits
            size = count * self.low_bits
            bits = np.unpackbits(np.frombuffer(self.low[at // 8 : -(-(at + size) // 8)], np.uint8), bitorder="little")
            bits = bits[at % 8 : at % 8 + size].reshape(count, self.low_bits)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def runs(self) -> Iterator[np.ndarray]:
        """All values, from sample to sample."""
        for first in range(0, self.n, SAMPLE):
            yield self.run(first)

    def to_bytes(self) -> bytes:
        return struct.pack("<IBII", self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, lows, highs = struct.unpack_from("<IBII", data, at)
        at += 13
        low, high = data[at : at + lows], data[at + lows : at + lows + highs]
        at += lows + highs
        count = -(-n // SAMPLE)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", count, at)), at + 4 * count


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: list[np.ndarray]) -> bytes:
    """doc_ids ascending, nulls first; ids of one type, in runs that may divide documents."""
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    flat = np.concatenate(ids)
    base = int(known[0]) if len(known) else 0
    body = b"".join((
        MAGIC,
        struct.pack("<IQBI", len(doc_ids), len(flat), flat.dtype.itemsize, len(doc_ids) - len(known)),
        struct.pack("<q", base),
        EliasFano.of((known - base).astype(np.uint64)).to_bytes(),
        EliasFano.of(np.cumsum(lengths)).to_bytes(),
        flat.tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """One shard read back; ``ids(i)`` reaches a document through ``select`` alone."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or struct.unpack_from("<I", data, len(data) - 4)[0] != zlib.crc32(data[:-4]):
            raise ValueError("damaged token shard")
        self.n_docs, self.n_ids, width, self.nulls = struct.unpack_from("<IQBI", data, 4)
        (self.lowest,) = struct.unpack_from("<q", data, 21)
        self.keys, at = EliasFano.read(data, 29)
        self.ends, at = EliasFano.read(data, at)
        self.flat = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [k + self.lowest for run in self.keys.runs() for k in run.tolist()]

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(begin, ids) of every document, its offsets selected run by run."""
        begin = 0
        for run in self.ends.runs():
            for end in run.tolist():
                yield begin, self.flat[begin:end]
                begin = end


def write_token_files(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, shard_ids: int = 1 << 22, partitions: int | None = None) -> None:
    """Write ``docs`` as token shards in ascending ``key`` order below ``path``."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    own = text_or_empty(docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")))
    if partitions is None:  # as the input asks, and never fewer than the session wants
        size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, 0
        enc = encoder(vocabulary)
        last = np.array([end_id], enc.dtype)
        keys: list[int | None] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "n_docs": len(keys), "n_ids": held, "shard": pack_shard(keys, lengths, ids)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("shard", pa.binary())]))

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                for k, own in zip(piece.column(0).to_pylist(), enc.encode(piece.column(1).to_pylist())):
                    if keys and held + len(own) + 1 > shard_ids:
                        yield shard()
                        keys, lengths, ids, held, seq = [], [], [], 0, seq + 1
                    keys.append(k)
                    lengths.append(len(own) + 1)
                    ids += [own, last]
                    held += len(own) + 1
        if keys:
            yield shard()

    dealt = own.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions, "key", "tie").sortWithinPartitions("key", "tie", "text")
    dealt.select("key", "text").mapInArrow(encode, SHARD_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, in no order; see the module's text."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # Parts are as many as the writer's range partitions, so this table is small whatever the input.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    earlier = Window.partitionBy("part").orderBy("seq")
    starts = shards.select("part", "seq", (F.sum("n_ids").over(earlier) - F.col("n_ids")).alias("seq_start")).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("shard_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*(batch.column(i) for i in range(3))):
                shard = Shard(data.as_buffer().to_pybytes())
                n = shard.n_docs
                own = [(begin, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for begin, ids in shard.documents()]
                columns = [pa.array([x.as_py()] * n, pa.int32()) for x in (part, seq)] + [pa.array(shard.doc_ids(), pa.int64())]
                columns += [pa.array(c, pa.int64()) for c in zip(*own)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", key, "begin", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "shard").mapInArrow(decode, f"part int, seq int, {key} long, begin long, n_tokens long, ids_crc32 long")
    # The starts have a row a shard of some MB: as few as the input's blocks. Spark decides by their size how to join.
    return rows.join(starts, ["part", "seq"]).select(key, (F.col("begin") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files and return what the files hold of each."""
    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)


QUERIES = {"op10_token_files": op10_token_files}
ORACLE: dict[str, str] = {}
