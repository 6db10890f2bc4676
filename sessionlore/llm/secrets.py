"""Secret scans with DataFrame functions only.

Base matches (kinds ``assign``, ``access`` and ``hex``) are regular expressions.
Beyond them, every long run of key-like characters is scored by two first-order
Markov chains over its characters, one learned from random strings and one from
ordinary identifiers: the log-likelihood ratio a character must exceed a
threshold. Both chains are counted from labelled samples: values of base matches
as random strings, and all other words and numbers as ordinary ones. The query takes
each class from a bounded number of documents, random strings from such as have
any, so rare secrets do not leave the first chain without samples. The corpus is
scanned once; the scores are taken from the table of its spans and runs.

Spark has no function that tells where a pattern matched. The pieces between
matches (``split``) and the matches themselves (``regexp_extract_all``) come from
the same scan, so their lengths add up to the positions, in code points.

A null or empty text has no matches. A text of any length is scanned whole; work
and memory grow in proportion to it. Spans that tie in start are listed in the
order of the kinds. A run beside a control character 1 is not scored. Rows are
independent, so repeated rows give repeated results; an empty table gives an
empty result; other columns are not read. Without random samples no string is
reported beyond the base matches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs shorter than the least length never count, and a run found from the left is whole, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
#: What the Markov models look at, and the strings that serve as ordinary samples.
#: A run is whole, and none of it lies under the cover of a base match.
MARK = "\x01"
CANDIDATE = r"(?<![A-Za-z0-9+/_=\x01-])[A-Za-z0-9+/_=-]{16,}+(?!\x01)"
ORDINARY = r"[A-Za-z0-9_-]{6,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SAMPLE_DOCS = 4_000
#: Matches whose lengths are added up together.
BLOCK = 256
#: Nats a character by which a string must look more random than ordinary.
LEAST_RATIO = 0.8
#: Weight of a character's overall share against the counts of its transitions.
BACKOFF = 5.0
KINDS = ("assign", "access", "hex", "markov")


def positions(text: Column, pattern: str, matches: Column) -> Column:
    """array<struct<start, end, value>> of the matches, which ``pattern`` found in ``text``.

    Lengths are added up in blocks, as a list that grows by one copies itself each time.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("value"))
    )

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        one = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    def block(steps: Column, number: Column) -> Column:
        return F.aggregate(F.slice(steps, number * BLOCK + 1, BLOCK), F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    def moved(local: Column) -> Column:
        ends = F.aggregate(local, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        return bound(
            lambda v: F.flatten(
                F.zip_with(
                    v["local"],
                    F.slice(v["ends"], 1, F.size(v["local"])),
                    lambda x, first: F.transform(
                        x["spans"], lambda s: F.struct((s["start"] + first).alias("start"), (s["end"] + first).alias("end"), s["value"].alias("value"))
                    ),
                )
            ),
            local=local,
            ends=ends,
        )

    numbers = lambda steps: F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
    blocks = bound(lambda v: F.transform(numbers(v["steps"]), lambda n: block(v["steps"], n)), steps=steps)
    return F.when(F.size(matches) > 0, bound(lambda v: moved(v["local"]), local=blocks)).otherwise(none)


def bound(body: Callable[[Column], Column], **columns: Column) -> Column:
    """``body`` of the columns as fields of one value. The optimizer moves a column's
    expression to where it is used; inside a lambda it would run for each element."""
    return F.transform(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))), body)[0]


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with columns assign, access and hex: arrays of (start, end, value)."""
    found = docs
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        found = found.withColumn(f"_{kind}", F.regexp_extract_all(F.col(text), F.lit(pattern), 0))
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        found = found.withColumn(kind, positions(F.col(text), pattern, F.col(f"_{kind}"))).drop(f"_{kind}")
    return found.withColumn("assign", F.filter("assign", lambda s: is_assign(s["value"])))


def is_assign(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= LEAST_VALUE


def covered(text: Column) -> Column:
    """The text with each base match of kind assign covered by as many marks."""
    matches, gaps = F.regexp_extract_all(text, F.lit(ASSIGN), 0), F.split(text, ASSIGN, -1)
    cover = lambda m: F.when(is_assign(m), F.repeat(F.lit(MARK), F.length(m))).otherwise(m)
    return F.array_join(F.zip_with(gaps, matches, lambda g, m: F.concat(g, F.coalesce(cover(m), F.lit("")))), "")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, assign, access, hex, open): base spans, and the runs that touch none of them.

    A hex or access match lies inside one run, so the run's own text tells.
    """
    own = text_or_empty(docs.select(key, F.col(text).cast("string").alias(text)), text)
    found = base_spans(own, text).withColumn("_left", F.when(F.size("assign") > 0, covered(F.col(text))).otherwise(F.col(text)))
    found = found.withColumn("_runs", F.regexp_extract_all("_left", F.lit(CANDIDATE), 0))
    found = found.withColumn("_runs", positions(F.col("_left"), CANDIDATE, F.col("_runs")))
    plain = F.filter("_runs", lambda c: ~F.rlike(c["value"], F.lit(HEX)) & ~F.rlike(c["value"], F.lit(ACCESS)))
    return found.select(key, *KINDS[:3], plain.alias("open"))


def labelled_samples(docs: DataFrame, found: DataFrame, sample_docs: int = SAMPLE_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(value, random): values of base matches from at most ``sample_docs`` documents
    that have any, and ordinary words from as many of all documents. Both are chosen
    by a hash of the key; ``found`` is what ``candidates`` makes of ``docs``."""

    def few(rows: DataFrame) -> DataFrame:
        ids = rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(sample_docs)
        return F.broadcast(ids)  # bounded by sample_docs

    values = F.concat(
        F.transform("assign", lambda s: F.regexp_extract(s["value"], ASSIGN, 2)),
        F.transform("access", lambda s: s["value"]),
        F.transform("hex", lambda s: s["value"]),
    )
    matched = found.where((F.size("assign") > 0) | (F.size("access") > 0) | (F.size("hex") > 0))
    random = matched.join(few(matched), key).select(F.explode(values).alias("value"), F.lit(True).alias("random"))
    # A table of its own: patterns must not run below the join, on all texts.
    some = written(docs.select(key, text).join(few(docs), key), "secret-samples")
    kept = base_spans(some, text).select(values.alias("hidden"), F.regexp_extract_all(text, F.lit(ORDINARY), 0).alias("words"))
    apart = bound(
        lambda v: F.filter(v["words"], lambda w: ~F.exists(v["hidden"], lambda r: F.contains(r, w) | F.contains(w, r))),
        words=F.col("words"),
        hidden=F.col("hidden"),
    )
    return random.unionByName(kept.select(F.explode(apart).alias("value"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of (previous character or start, character), row by row.

    The counts have at most a row for each pair of the alphabet and class.
    """
    width = len(ALPHABET)
    at = F.expr(f"transform(split(value, ''), c -> instr('{ALPHABET}', c))")
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), F.slice("at", 1, F.size("at") - 1)), F.col("at"), lambda p, c: F.struct(p.alias("p"), c.alias("c")))
    steps = samples.where(F.length("value") > 0).select("random", at.alias("at")).select("random", F.explode(pairs).alias("s")).where("s.c > 0")
    counts = {(r.random, r.p, r.c): r.n for r in steps.groupBy("random", F.col("s.p").alias("p"), F.col("s.c").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not any(k[0] for k in counts):
        return [0.0] * ((width + 1) * width)
    after, single, every = Counter(), Counter(), Counter()
    for (random, p, c), n in counts.items():
        after[random, p] += n
        single[random, c] += n
        every[random] += n

    def log(random: bool, p: int, c: int) -> float:
        """Of a transition; one that was rarely seen leans on the character's own share."""
        share = (single[random, c] + 0.5) / (every[random] + 0.5 * width)
        return math.log((counts.get((random, p, c), 0) + BACKOFF * share) / (after[random, p] + BACKOFF))

    return [log(True, p, c) - log(False, p, c) for p in range(width + 1) for c in range(1, width + 1)]


def mean_ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio a character; the model is a folded literal array."""
    table_ = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    at = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        return F.struct(c.alias("p"), (acc["sum"] + F.element_at(table_, acc["p"] * len(ALPHABET) + c)).alias("sum"))

    return F.aggregate(at, start, step, lambda acc: acc["sum"]) / F.length(value)


def mark(found: DataFrame, model: list[float], least_ratio: float = LEAST_RATIO, key: str = "doc_id") -> DataFrame:
    """(key, assign, access, hex, markov, spans) from ``candidates``: arrays of (start, end, value), and all spans in order."""
    scored = F.filter("open", lambda c: mean_ratio(c["value"], model) >= least_ratio)
    found = found.withColumn("markov", F.when(F.size("open") > 0, scored).otherwise(F.col("open")))
    ordered = F.array_sort(F.concat(*(ranked(kind, rank) for rank, kind in enumerate(KINDS))))
    return found.select(key, *KINDS, ordered.alias("spans"))


def scan(docs: DataFrame, model: list[float], least_ratio: float = LEAST_RATIO, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All spans of every row of ``docs``, as ``mark`` returns them."""
    return mark(candidates(docs, key, text), model, least_ratio, key)


def ranked(kind: str, rank: int) -> Column:
    """Spans of a kind in the form that sorts by start, then kind."""
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    spans = written(candidates(docs), "secret-spans")  # spans and runs only, no texts
    found = mark(spans, train(labelled_samples(docs, spans)))
    base = listed(F.filter("spans", lambda s: s["kind"] != "markov"))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op4_secrets": op4_secrets}
ORACLE: dict[str, str] = {}
