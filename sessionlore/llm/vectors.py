"""Near-duplicate vectors by int8 tile products with error bounds.

Vectors of one label are compared in square tiles. In a tile rows are first scaled
by powers of two, which changes no cosine and lets no norm over- or underflow.
Each unit vector u is held as scale * q with q in int8; the products of the q are exact (sums of
int8 products stay below 2**24, so float32 matrix products give whole numbers).
With e = |u - scale * q| the true cosine differs from the product by at most
|scale * q_x| * e_y + e_x, so only pairs whose product plus that bound reaches
the threshold are computed again in double precision from the given numbers.

Equal vectors of a label are one row with a count before any tile is made, and
a tile returns at most a row a vector (its links, and the smallest vector it
reaches there), so groups of copies never become pairs. Tiles of one label lie
in many tasks. The work within a label grows with the square of its different
vectors, as exact tile products must, and the shuffle with that square over the
rows of a tile.

Vectors that are null, empty, zero, or hold null or non-finite components, and
rows with a null label or id, link with nothing. Vectors of different lengths
do not link. A pair that ties with the threshold links. A long vector makes its
tiles narrower. Rows that share a vec_id are one node of the graph, and their
links add up. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut, table
from .graph import components, roots

THRESHOLD = 0.98
TILE_BYTES, LEAST_ROWS, MOST_ROWS = 32 << 20, 256, 8_192
#: Dimensions whose int8 products surely stay below 2**24.
EXACT_DIMS = 1024
SLOP = 1e-9


def tile_rows(dims: Column) -> Column:
    """Vectors in a block: as many as make 32 MB of doubles, within bounds. Large tiles shuffle less."""
    return F.least(F.lit(MOST_ROWS), F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(TILE_BYTES / 8) / dims)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component near 1: exact, and no norm over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, error norms, norms of scale * code) of the unit vectors along the rows."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    held = code * scale[:, None]
    return code, scale, np.linalg.norm(unit - held, axis=1), np.linalg.norm(held, axis=1)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of int8 rows, exactly, through float32 matrix products."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, d : d + EXACT_DIMS].astype(np.float32) @ b[:, d : d + EXACT_DIMS].astype(np.float32).T
    return out


def link_parts(x: np.ndarray, y: np.ndarray, threshold: float, rows: int = 256, most: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with cosine(x[i], y[j]) >= threshold, some rows of x at a time."""
    x, y = scaled(x), scaled(y)
    cx, sx, ex, hx = quantise(x)
    cy, sy, ey, _ = quantise(y)
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    for at in range(0, len(x), rows):
        part = slice(at, at + rows)
        upper = code_products(cx[part], cy) * (sx[part, None] * sy) + (hx[part, None] * ey + ex[part, None])
        i, j = np.nonzero(upper >= threshold - SLOP)
        i += at
        sure = np.zeros(len(i), bool)
        for k in range(0, len(i), most):
            a, b = i[k : k + most], j[k : k + most]
            sure[k : k + most] = (x[a] * y[b]).sum(axis=1) / (nx[a] * ny[b]) >= threshold
        yield i[sure], j[sure]


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, tile: int | None = None, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(key, n_links, component_id, kept), a row for each row of ``vectors``."""
    # Floats travel as floats; they become doubles in the tiles.
    kind = "array<float>" if vectors.schema[vector].dataType == ArrayType(FloatType(), vectors.schema[vector].dataType.containsNull) else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.col(label).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = rows.withColumn("print", F.when(F.col("sound"), F.sha2(F.to_json("v").cast("binary"), 256)))
    groups = cut(rows.where("sound").groupBy("label", "print").agg(F.min(F.struct("id", "v")).alias("first"), F.count(F.lit(1)).alias("copies")).select("label", "print", F.col("first.id").alias("rep"), F.col("first.v").alias("v"), "copies"))

    # Tiles: each label has as many blocks as its vectors fill; a vector meets every block of its label and length.
    sizes = cut(groups.groupBy("label", F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")))
    width = F.lit(tile) if tile else tile_rows(F.col("dims"))
    sizes = sizes.select("label", "dims", F.ceil(F.col("n") / width).cast("int").alias("blocks"))
    dealt = groups.withColumn("dims", F.size("v")).join(sizes, ["label", "dims"]).withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("label", "dims", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("right"), "rep", "copies", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        ids, copies, right = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["right"].to_numpy()
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            left = other = np.arange(len(x))
        else:
            left, other = np.flatnonzero(~right), np.flatnonzero(right)
        links = np.zeros(len(x), np.int64)
        forest = [(ids[:0], ids[:0])]  # (vector, smallest one it reaches) of each part
        for a, b in link_parts(x[left], x[other], threshold):
            a, b = left[a], other[b]
            differ = a != b
            a, b = a[differ], b[differ]
            links += np.bincount(a, copies[b], len(x)).astype(np.int64)
            if left is not other:
                links += np.bincount(b, copies[a], len(x)).astype(np.int64)
            nodes, least = roots(ids[a], ids[b])
            forest.append((nodes[nodes != least], least[nodes != least]))
        at = np.flatnonzero(links)
        nodes, least = roots(*(np.concatenate(c) for c in zip(*forest)))
        return pd.DataFrame({"rep": ids[at], "links": links[at], "root": least[np.searchsorted(nodes, ids[at])]})

    found = cut(meets.groupBy("label", "dims", "i", "j").applyInPandas(compare, "rep long, links long, root long"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = cut(groups.select("label", "print", "rep", "copies").join(counts, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("label", "print", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")))
    own = rows.select("id", "label", "print").join(known, ["label", "print"], "left")
    component = F.coalesce("component", "id")
    return own.select(F.col("id").alias(key), (F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings with equal labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_vectors": op7_vectors}
ORACLE = {
    "op7_vectors": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL
        AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98
), reach AS (
    SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id)::BIGINT AS n_links, (SELECT min(y) FROM reach r WHERE r.x = e.vec_id) AS component_id,
    vec_id = (SELECT min(y) FROM reach r WHERE r.x = e.vec_id) AS kept
FROM embeddings e
""",
}
