"""The training-data pipeline: five stages from ``documents`` to packed sequences.

Each stage works on all that the one before it kept. Stages in between return
the columns of ``documents``, whatever their number and names; the last returns the
pieces of the sequences.

Every stage keeps to what its operator's module states: null and empty texts have the
score of the model's intercept, are near copies of nothing, hold no personal data, are
mixed like others and have one piece of one token; rows with a null doc_id stay; of
repeated rows one is left after the second stage; texts of any length are whole; an
empty table makes every stage return an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlore.llm import mixing, ngram_join, packing, pii, toxicity
from sessionlore.llm.common import table, written

#: No SQL has the trained classifier, the tokenizer or the packing plan; tests hold the run against a brute-force version.
ORACLE_SQL = None
#: Words a tokenizing worker remembers here: workers keep this memory while other stages run.
REMEMBERED = 50_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score lies below the threshold."""
    return toxicity.clean(docs, toxicity.trained(spark, sf_dir, docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of linked documents."""
    return ngram_join.deduplicated(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced and disclosing terms removed or generalised."""
    hidden = pii.sanitise(docs)
    return hidden.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources up to the repetition limit."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of 2048."""
    return packing.pack(docs, remembered=REMEMBERED)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
