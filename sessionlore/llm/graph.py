"""Connected components of a link table, by alternating star contractions.

Each round points every node at the smallest neighbour it sees (large star,
then small star) until the links no longer change; the number of rounds grows
with the logarithm of the longest path. Minima are aggregated before they are
joined back, so a node with very many links is pre-aggregated in each task and
its links can be split between tasks. Every round ends in a checkpoint in the
shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of the links a[i] - b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        while (jump := after[after]).tolist() != after.tolist():
            after = jump
        if (after == label).all():
            return nodes, nodes[label]
        label = after


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            v, root = roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            keep = v != root
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(root[keep])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each node of ``links`` (a, b: long) that has a smaller
    one in its component, the smallest. Nodes without a row are their own."""
    pairs = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    now = cut(pairs.mapInArrow(_forests, "a long, b long").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = cut(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        low = cut(down.groupBy("a").agg(F.min("b").alias("m")))
        small = down.join(low, "a").select(F.col("b").alias("v"), "m").where("v <> m").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        mark = seen
