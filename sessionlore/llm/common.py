"""Small helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch, shared_dir, written

__all__ = ["cut", "passes", "scratch", "shared_dir", "sieve", "slices", "small_batches", "table", "text_or_empty", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: The seed of Spark's ``xxhash64``.
SPARK_SEED = 42
#: A sieve has so many bits for each number in it, between 8 KiB and 64 MiB in all. With more
#: than some 3 * 10**7 numbers it lets more others pass, so its users check what passed.
SIEVE_BITS, SIEVE_LEAST, SIEVE_MOST = 16, 1 << 10, 1 << 23


def sieve(hashes: DataFrame, words: int | None = None) -> np.ndarray:
    """A Bloom filter with two probes of the 64-bit numbers in ``hash``, put together by Spark.
    Its size in 64-bit words follows their number, unless it is given."""
    if words is None:
        words = min(SIEVE_MOST, max(SIEVE_LEAST, 1 << (hashes.count() * SIEVE_BITS // 64).bit_length()))
    places = F.array(F.pmod("hash", F.lit(64 * words)), F.pmod(F.shiftright("hash", 32), F.lit(64 * words)))
    bits = hashes.select(F.explode(places).alias("place"))
    word, bit = F.floor(F.col("place") / 64).cast("int"), F.expr("shiftleft(1L, cast(place % 64 as int))")
    made = bits.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[made["word"].to_numpy()] = made["bits"].to_numpy()
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each number may be in the sieve: true for all that are."""
    hashes = hashes.view(np.int64)
    sure = np.ones(len(hashes), bool)
    for h in (hashes, hashes >> np.int64(32)):
        place = h % np.int64(64 * len(bits))  # the remainder is never negative, like pmod
        sure &= (bits[place >> 6] >> (place & 63)) & 1 == 1
    return sure


#: Whole texts reach Python in batches of at most so many rows.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches, made for short rows, to what whole texts need."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_or_empty(df: DataFrame, text: str = "text") -> DataFrame:
    """Null texts as empty strings."""
    small_batches(df.sparkSession)
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


#: A slice of a batch has at most so many rows, and texts of about so many bytes or a single one.
SLICE_ROWS, SLICE_BYTES = 128, 8 << 20


def slices(batch: pa.RecordBatch, text: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, bounded by rows and by the bytes of its column ``text``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    reached, start = np.cumsum(lengths, dtype=np.int64), 0
    while start < batch.num_rows:
        before = reached[start - 1] if start else 0
        end = max(start + 1, min(start + rows, int(np.searchsorted(reached, before + size, "right"))))
        yield batch.slice(start, end - start)
        start = end
