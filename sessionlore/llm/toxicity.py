"""Toxicity by character n-grams under naive Bayes log-count ratios.

A document's features are the hashed character n-grams it holds (present or
not), over the lower-cased text with runs of white space as one space. From
labelled documents come the naive Bayes log-count ratios r of each feature. The
``features`` times as many as there are fitted documents that differ most between
the classes (by chi-square) are kept; the rest would be learnt by heart. FEATURES was
chosen by ``validate``, three folds of the training labels alone (2,990 at sf0.1): a
ninth, a third, one and three times as many lose 0.097, 0.087, 0.109 and 0.133 nats a
document, catch 0.83, 0.84, 0.80 and 0.75 of the toxic and reject 0.011, 0.008, 0.011
and 0.012 of the clean. A logistic regression is then fitted on features scaled
by r, as published by Wang
and Manning (2012). A document's score is the fitted probability of label 1.

Fitting uses at most ``fit_rows`` labelled documents, those first by a hash of
their id, so its cost and what reaches the driver stay bounded: a count for each
of the 2**20 hashed features, and per document the few hundred selected features
it has. Scoring covers every document; it is one pass without a shuffle.

A null or empty text has no features and gets the score of the intercept. A text
of any length is read whole, in overlapping spans. Features that tie at the bound
are taken in the order of their hashes.
Labelled rows without label, id or document are not used in fitting, nor are
ids with conflicting labels; repeated labelled rows count once. Every row of a repeated
document is scored; in fitting, rows of one id with different texts are documents of
their own, equal ones one. An empty table of documents gives an empty result, as does
scoring it by any model. With no usable
label of one class the model is the share of toxic labels (0 where there are
none). Other columns are not read; label, language, source and id never enter a
score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table, text_or_empty

BITS = 20
SIZES = (3, 4, 5, 6)
FIT_ROWS = 12_000
#: Selected features for each fitted document: few enough not to learn them by heart.
FEATURES = 1 / 3
LEAST_DOCS = 3
THRESHOLD = 0.3
#: Characters that are looked at together; longer texts are taken in overlapping windows.
SPAN = 1 << 20
SPACE = re.compile(r"\s+")
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def buckets(text: str, sizes: tuple[int, ...] = SIZES) -> Iterator[np.ndarray]:
    """Hashed n-grams at every position of the text, size by size; every position is covered."""
    text = f" {SPACE.sub(' ', text.lower()).strip()} "
    for at in range(0, len(text), SPAN):
        code = np.frombuffer(text[at : at + SPAN + max(sizes) - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        held, power = code.copy(), np.uint64(1)
        for n in range(2, max(sizes) + 1):
            if len(code) < n:
                break
            held = held[:-1] * MIX[0] + code[n - 1 :]
            if n in sizes:
                mixed = (held ^ np.uint64(n)) * MIX[1]
                yield (mixed >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Model:
    """The hashed features that count, in order, and their weights."""

    kept: np.ndarray
    weight: np.ndarray
    bias: float

    @cached_property
    def slot(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.kept] = np.arange(len(self.kept))
        return out

    def features(self, text: str) -> np.ndarray:
        found = [x[x >= 0] for x in (self.slot[b] for b in buckets(text))]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)

    def score(self, text: str) -> float:
        return float(sigmoid(np.array(self.bias + self.weight[self.features(text)].sum())))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


def fit_linear(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, l2: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by ``scale``; (weights times scale, bias)."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    norm = 1 / np.sqrt(np.maximum(1, np.bincount(flat, minlength=len(scale))))  # a diagonal preconditioner
    value = (scale * norm)[flat]
    w = v = np.zeros(len(scale))
    share = labels.mean()
    b = u = float(np.log(share / (1 - share)))
    squares = np.bincount(owner, value * value, len(rows)) + 1
    step = 4 / max(np.bincount(owner, minlength=len(rows)).max(initial=1), squares.max()) * len(rows) ** 0.5
    t = 1.0
    for _ in range(steps):
        gap = sigmoid(np.bincount(owner, v[flat] * value, len(rows)) + u) - labels
        gw = np.bincount(flat, gap[owner] * value, len(scale)) / len(rows) + l2 * v
        w_next, b_next = v - step * gw, u - step * gap.mean()
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, u = w_next + (before - 1) / t * (w_next - w), b_next + (before - 1) / t * (b_next - b)
        if gw @ (w_next - w) + gap.mean() * (b_next - b) > 0:  # overshot: drop the momentum
            t, v, u = 1.0, w_next, b_next
        w, b = w_next, b_next
    return w * norm * scale, b


def count_features(sample: DataFrame) -> DataFrame:
    """(bucket, toxic, clean): documents of each class that hold a feature; ``sample`` has text and toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[toxic][np.unique(np.concatenate(list(buckets(text)) or [np.zeros(0, np.int32)]))] += 1
        at = np.flatnonzero(held.any(axis=0))
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[1][some], pa.int32()), pa.array(held[0][some], pa.int32())], names=["bucket", "toxic", "clean"])

    rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(count, "bucket int, toxic int, clean int")
    return rows.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: float = FEATURES, least_docs: int = LEAST_DOCS, tasks: int = 8) -> Model:
    """Fit on at most ``fit_rows`` of the labelled documents; ``labels`` has doc_id and toxic (0 or 1)."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    chosen = usable.where("toxic = most").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # The chosen rows are bounded by fit_rows, so the documents need no shuffle to meet them.
    met = text_or_empty(docs.select("doc_id", F.col("text").cast("string").alias("text"))).join(F.broadcast(chosen), "doc_id")
    sample = cut(met.distinct().repartition(tasks).select("text", F.col("toxic").cast("int").alias("toxic")))
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    empty = np.zeros(0)
    if not bad or not good:
        share = min(max(bad / max(bad + good, 1), 1e-6), 1 - 1e-6)
        return Model(empty.astype(np.int64), empty, float(np.log(share / (1 - share))))
    seen = F.col("toxic") + F.col("clean")
    expected = seen * F.lit(bad / (bad + good))
    surprise = (F.col("toxic") - expected) ** 2 / expected + (F.col("toxic") - expected) ** 2 / (seen - expected)
    best = count_features(sample).where(seen >= least_docs).withColumn("surprise", surprise).orderBy(F.desc("surprise"), "bucket").limit(max(300, int(features * (bad + good)))).collect()
    toxic, clean = (np.array([r[c] for r in best], float) for c in ("toxic", "clean"))
    ratio = np.log((toxic + 1) / (bad + 2)) - np.log((clean + 1) / (good + 2))
    model = Model(np.array([r.bucket for r in best], np.int64), np.zeros(len(best)), 0.0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.features(x) for x in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], names=["held", "toxic"])

    rows = sample.mapInArrow(read, "held array<int>, toxic int").collect()
    weight, bias = fit_linear([np.array(r.held, np.int64) for r in rows], np.array([r.toxic for r in rows], float), ratio)
    return Model(model.kept, weight, bias)


def folds_of(folds: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(folds))


def validate(docs: DataFrame, labels: DataFrame, features: float, folds: int = 3, threshold: float = THRESHOLD) -> tuple[float, float, float]:
    """By cross-validation within ``labels``: the mean loss in nats, and the shares of toxic and of
    clean documents that are rejected. This is how FEATURES was chosen, see the module's text."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sums = np.zeros(5)
    for k in range(folds):
        own = folds_of(folds) == k
        model = train(docs, usable.where(~own), features=features)
        # Labelled documents of one fold; the labels' side is as bounded as the labels are.
        met = docs.select("doc_id", "text").join(usable.where(own), "doc_id")
        p = F.least(F.greatest(F.col("score"), F.lit(1e-12)), F.lit(1 - 1e-12))
        loss = -F.when(F.col("toxic") == 1, F.log(p)).otherwise(F.log(1 - p))
        scored = score(met, model).join(usable, "doc_id").withColumn("rejected", (F.col("score") >= threshold).cast("int"))
        of = lambda label: F.col("toxic") == label
        row = scored.agg(F.sum(loss), F.count_if(of(1)), F.count_if(of(0)), F.count_if(of(1) & (F.col("rejected") == 1)), F.count_if(of(0) & (F.col("rejected") == 1))).first()
        sums += np.array([x or 0 for x in row], float)
    loss, bad, good, caught, lost = sums
    return loss / max(bad + good, 1), caught / max(bad, 1), lost / max(good, 1)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every document, in one pass."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(x) for x in batch.column(1).to_pylist()], pa.float64())], names=[key, "score"])

    return text_or_empty(docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)), text).mapInArrow(apply, f"{key} long, score double")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a score below the threshold; all columns stay, whatever their names."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(x or "") for x in texts], dtype=float)

    return docs.where(probability(F.col("text").cast("string")) < threshold)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row's label is kept from training."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """The model of the labelled rows that are not held out."""
    return train(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, trained(spark, sf_dir, docs))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict[str, str] = {}
