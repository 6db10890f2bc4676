"""Media columns: text payloads as PNG images, read back and hashed.

Every value becomes an 8-bit greyscale PNG of 64 pixels a row in a binary
column: the payload is the text in UTF-8, padded with zero bytes to a positive
multiple of 64. The reader walks the PNG chunks, tests each checksum, inflates
the IDAT stream, and undoes the row filters with numpy. A perceptual hash of
the decoded image follows: block means on a 32 x 32 grid, a cosine transform in
whole numbers (so equal images hash equally on any machine), and the signs of
the 8 x 8 lowest frequencies against their median.

Null text is the empty text, whose payload is 64 zero bytes. A text of any length
is one image of as many rows as it takes. Equal texts, which may tie in every
column, and repeated rows give repeated, equal results; frequencies that tie with
the median count as not above it. An empty table gives an empty result. Input
columns besides the key and the text are not read, so they can have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRID, LOW = 32, 8
#: Rows of the cosine transform in 14-bit fixed point.
COSINES = np.rint(np.cos(np.pi * (2 * np.arange(GRID)[None, :] + 1) * np.arange(LOW)[:, None] / (2 * GRID)) * (1 << 14)).astype(np.int64)


class MediaError(ValueError):
    """Bytes that are not a readable 8-bit greyscale PNG."""


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """The payload as image rows; each row takes the cheapest of filters none, sub and up."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    made = np.stack([rows, sub, up])
    cost = np.abs(made.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0).astype(np.uint8)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = np.take_along_axis(made, best[None, :, None].astype(np.int64), axis=0)[0]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the row filters of (height, 1 + width) bytes, one byte a pixel."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise MediaError("unknown row filter")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    if not (kinds >= 2).any():
        return out
    if not (kinds >= 3).any():
        # Runs of "up" rows add down from the row above them: a running sum less what it was there.
        held = np.cumsum(out, axis=0, dtype=np.uint8)
        start = np.maximum.accumulate(np.where(kinds != 2, np.arange(len(out)), 0))
        before = np.zeros_like(out)
        inner = start > 0
        before[inner] = held[start[inner] - 1]
        return held - before
    above = np.zeros(out.shape[1], np.int64)
    for y, kind in enumerate(kinds):
        line = out[y]
        if kind == 2:
            line += above.astype(np.uint8)
        elif kind == 3:
            left = 0
            for x in range(len(line)):
                left = (int(line[x]) + (left + int(above[x])) // 2) & 255
                line[x] = left
        elif kind == 4:
            left = corner = 0
            for x in range(len(line)):
                b = int(above[x])
                guess = left + b - corner
                near = min((abs(guess - left), 0, left), (abs(guess - b), 1, b), (abs(guess - corner), 2, corner))[2]
                left, corner = (int(line[x]) + near) & 255, b
                line[x] = left
        above = line.astype(np.int64)
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Pixels of an 8-bit greyscale PNG; MediaError where anything is off."""
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, shape, packed, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise MediaError("cut short")
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(media):
            raise MediaError("cut short")
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if len(body) != 13:
                raise MediaError("header of another length")
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlaced) != (8, 0, 0):
                raise MediaError("not 8-bit greyscale")
            shape = (height, width)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + size
    if shape is None or not ended:
        raise MediaError("no header or end")
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != shape[0] * (shape[1] + 1):
        raise MediaError("wrong number of pixels")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(shape[0], shape[1] + 1))


def shrink(pixels: np.ndarray, grid: int = GRID) -> np.ndarray:
    """Whole-number block means on a grid; small images repeat their pixels."""

    def edges(n: int) -> tuple[np.ndarray, np.ndarray]:
        lo = np.arange(grid) * n // grid
        return lo, np.maximum(lo + 1, (np.arange(grid) + 1) * n // grid)

    (top, bottom), (left, right) = edges(pixels.shape[0]), edges(pixels.shape[1])
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])
    area = (bottom - top)[:, None] * (right - left)[None, :]
    return (total[bottom][:, right] - total[top][:, right] - total[bottom][:, left] + total[top][:, left]) // area


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the lowest frequencies, the mean aside, exceed their median."""
    low = (COSINES @ shrink(pixels) @ COSINES.T).ravel()
    low[0] = 0
    return np.packbits(low > np.sort(low)[len(low) // 2]).tobytes()


MEDIA_SCHEMA = "{key} long, n_bytes long, media binary"
FEATURE_SCHEMA = "{key} long, n_bytes long, payload binary, media_bytes long, media_sha256 string, cosine_hash binary"


def payload_of(raw: bytes, width: int = WIDTH) -> bytes:
    return raw + bytes(-len(raw) % width or (0 if raw else width))


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text as a PNG in a binary column."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode_png(payload_of(x)) for x in raw], pa.binary())],
                names=[key, "n_bytes", "media"],
            )

    return text_or_empty(docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)), text).mapInArrow(encode, MEDIA_SCHEMA.format(key=key))


def media_features(media: DataFrame, key: str = "doc_id", payloads: bool = True) -> DataFrame:
    """Read every image back: its payload (on request), digests and cosine hash.

    A damaged image gives null in every derived column.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item in batch.column(2):
                stored = item.as_py()
                try:
                    pixels = decode_png(stored or b"")
                    rows.append((pixels.tobytes() if payloads else None, len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(pixels)))
                except (MediaError, zlib.error, struct.error):
                    rows.append((None, None, None, None))
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))],
                names=[key, "n_bytes", "payload", "media_bytes", "media_sha256", "cosine_hash"],
            )

    return media.select(key, "n_bytes", "media").mapInArrow(decode, FEATURE_SCHEMA.format(key=key))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's payload as read back from its image."""
    back = media_features(to_media(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.lower(F.hex("cosine_hash")).alias("feature"),
    )


QUERIES = {"op2_media": op2_media}
ORACLE: dict[str, str] = {}
