"""Mixing sources by temperature, realised as budgeted block permutations.

A source's natural share p of all tokens becomes the weight p**a, normalised. The
exponent a is bisected: for a target entropy of the weights, or so that no source
is repeated more than a limit allows (the flattest such mixture). The budget is a
number of tokens; left out, it is the least budget at which every source is used
in full at least once, so that no document is dropped.

A source's quota, its weight times the budget, is spent in passes. Full passes
take every document. The last, partial pass takes documents in a keyed
permutation: documents are dealt by a hash into ``blocks`` blocks a source,
1,024 or one for each 65,536 rows; blocks are ordered by a hash, and documents within the block where the
quota ends by a hash as well; the pass ends at the document whose middle lies
nearest below the quota. A cut is therefore two hash values for each source, and
every document decides for itself, so no source, however large, passes through
one task.

A null source is a source of its own. A null or empty text has no tokens and
takes part in full passes like any other. A text of any length counts whole, so a
partial pass can miss its quota by half of the document at the cut. Documents
that tie in their hash are drawn together. Equal rows share their hash and are
drawn together. An empty table gives an empty result. Other columns are kept by
``mix`` and not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Blocks of a source at least, and the rows from which on there are more.
BLOCKS, BLOCK_ROWS = 1024, 65_536
REPETITION = 1.5
SEED = 2024
WORD = r"[^\x20\x09-\x0D]+"


def weights(shares: list[float], exponent: float) -> list[float]:
    raw = [p**exponent if p > 0 else 0.0 for p in shares]
    total = sum(raw) or 1.0
    return [x / total for x in raw]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def repetitions(shares: list[float], exponent: float, budget_share: float | None) -> list[float]:
    """Passes over each source with tokens; the budget is a share of all tokens, or just enough to use every source once."""
    rates = [w / p for w, p in zip(weights(shares, exponent), shares) if p > 0]
    return [r * (budget_share if budget_share is not None else 1 / min(rates)) for r in rates]


def solve(
    shares: list[float], target_entropy: float | None = None, repetition: float | None = REPETITION, budget_share: float | None = None, steps: int = 60
) -> float:
    """The exponent: 0 makes all sources alike, 1 leaves natural shares, more favours the largest.

    ValueError where no mixture has the entropy, or keeps within the repetition.
    """
    used = [p for p in shares if p > 0]
    if not used:
        return 1.0
    if target_entropy is not None:
        top = sum(p >= max(used) * (1 - 1e-12) for p in used)
        if not math.log(top) - 1e-9 <= target_entropy <= math.log(len(used)) + 1e-9:
            raise ValueError(f"no weights of these sources have entropy {target_entropy}")

    def flat_enough(a: float) -> bool:  # true from some exponent on
        if target_entropy is not None:
            return entropy(weights(shares, a)) <= target_entropy
        return repetition is None or max(repetitions(shares, a, budget_share)) <= repetition

    if flat_enough(0.0):
        return 0.0
    low, high = 0.0, 1.0
    if target_entropy is None and not flat_enough(high):
        # At natural shares all sources repeat alike, which is the least that the budget allows.
        if max(repetitions(shares, high, budget_share)) > repetition + 1e-9:
            raise ValueError(f"this budget repeats some source more than {repetition} times in any mixture")
        return high
    while not flat_enough(high) and high < 1 << 20:
        low, high = high, 2 * high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if flat_enough(middle) else (middle, high)
    return high


def blocks_for(docs: DataFrame) -> int:
    """Blocks of a source: more with more rows, so that neither a block nor their list becomes large."""
    return max(BLOCKS, -(-docs.count() // BLOCK_ROWS))


def _keyed(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    """``docs`` with the source's key and the hashes that order blocks and documents."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return docs.withColumn("_source", key).withColumn("_draw", draw).withColumn("_block", F.xxhash64(F.lit(seed + 1), F.col("_source"), F.pmod(F.col("_draw"), F.lit(blocks))))


def words() -> Column:
    """Words of the text, the tokens that shares and budgets count."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def quotas(
    docs: DataFrame,
    target_entropy: float | None = None,
    repetition: float | None = REPETITION,
    budget: int | None = None,
    blocks: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """A row a source: _source, weight, passes (full ones), and the cut of the partial pass."""
    spark = docs.sparkSession
    blocks = blocks or blocks_for(docs)
    keyed = _keyed(docs.select("doc_id", "source", "text"), blocks, seed)
    # At most ``blocks`` rows a source.
    sums = written(keyed.withColumn("tokens", words()).groupBy("_source", "_block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    # A row a source: the list of sources is what a mixture is stated in.
    totals = sorted((r["_source"], r.tokens) for r in sums.groupBy("_source").agg(F.sum("tokens").alias("tokens")).collect())
    total = sum(n for _, n in totals)
    shares = [n / total if total else 0.0 for _, n in totals]
    budget_share = budget / total if budget is not None and total else None
    exponent = solve(shares, target_entropy, repetition, budget_share)
    mixed = weights(shares, exponent)
    rates = iter(repetitions(shares, exponent, budget_share) if total else [])
    rows = []
    for (source, tokens), share, weight in zip(totals, shares, mixed):
        passes = next(rates) if share > 0 else 1.0
        full = int(passes + 1e-9)
        rows.append((source, float(weight), full, max(0.0, (passes - full) * tokens)))
    stated = spark.createDataFrame(rows, "_source string, weight double, passes long, rest double")
    running = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = sums.withColumn("after", F.sum("tokens").over(running)).join(stated, "_source").where((F.col("after") >= F.col("rest")) & (F.col("rest") > 0))
    cut_block = reached.groupBy("_source").agg(F.min_by(F.struct("_block", (F.col("after") - F.col("tokens")).alias("before"), "rest"), F.struct("after", "_block")).alias("c")).select("_source", F.col("c._block").alias("_block"), F.col("c.before").alias("before"), F.col("c.rest").alias("rest"))
    inner = keyed.join(cut_block, ["_source", "_block"]).select("_source", "_block", "_draw", "before", "rest", words().alias("tokens"))
    inner = inner.groupBy("_source", "_block", "before", "rest", "_draw").agg(F.sum("tokens").alias("tokens"))  # equal rows are drawn together
    order = Window.partitionBy("_source", "_block").orderBy("_draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("tokens").over(order) - F.col("tokens") / 2
    cut_draw = inner.withColumn("middle", middle).where(F.col("middle") <= F.col("rest")).groupBy("_source").agg(F.max("_draw").alias("cut_draw"))
    cuts = cut_block.select("_source", F.col("_block").alias("cut_block")).join(cut_draw, "_source", "left")
    return written(stated.drop("rest").join(cuts, "_source", "left"), "mix-quotas")


def draws(docs: DataFrame, stated: DataFrame, blocks: int | None = None, seed: int = SEED) -> DataFrame:
    """(row, weight, block, copies): each row of ``docs`` as a struct, and the times it is drawn."""
    blocks = blocks or blocks_for(docs)
    own = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    keyed = _keyed(own, blocks, seed).join(stated, "_source")
    partial = (F.col("_block") < F.col("cut_block")) | ((F.col("_block") == F.col("cut_block")) & (F.col("_draw") <= F.col("cut_draw")))
    copies = F.col("passes") + F.when(F.coalesce(partial, F.lit(False)), 1).otherwise(0)
    return keyed.select("row", "weight", F.col("_block").alias("block"), copies.alias("copies"))


def mix(docs: DataFrame, blocks: int | None = None, seed: int = SEED, **goal: float | None) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is drawn."""
    blocks = blocks or blocks_for(docs)
    drawn = draws(docs, quotas(docs, blocks=blocks, seed=seed, **goal), blocks, seed).where("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is drawn, with its source's weight and its block."""
    docs = table(spark, sf_dir, "documents")
    blocks = blocks_for(docs)
    return draws(docs, quotas(docs, blocks=blocks), blocks).select("row.doc_id", "row.source", "weight", "block", "copies")


QUERIES = {"op5_mixing": op5_mixing}
ORACLE: dict[str, str] = {}
