"""Full-text and literal search over messages.

Ranked search is BM25 (k1 = 1.2, b = 0.75) over the stems of a message and its role. A
query of several words asks for the phrase. One of a single word may also say where and
how the word stands, see ``asked``; one that says it wrongly is a literal search.

A search reads the postings of its own stems (a persisted store keeps them sorted, so
other row groups are skipped) and the text of the few messages that it shows. The
numbers of messages, of their terms and of a word's hits come from the store's index.
There a search for one word also ends early: postings lie in levels of their weight,
the heaviest are read first, and no level is read that cannot hold one of the best any
more. ``stem=False`` asks for words as they stand and scans the messages.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import scalars, search_text
from ..functions.search_text import K1
from ..sources import shared, store, transcripts
from ..sources.facts import Facts, Index
from .reports import LIMIT, matching

SNIPPET_WORDS, SIDE = 20, 80
KEYS = ("session_key", "line_no", "role")
#: Columns that a query may name, with their postings; the others hold no words.
COLUMNS = {"message_type": "in_role", "content": "in_content"}
UNINDEXED = ("session_id", "timestamp")
#: Words that are no words of a query where they stand alone.
OPERATORS = ("AND", "OR", "NOT")
FORM = re.compile(r'(?:(-?)(?:(\w+)|\{(\w+)\}):)?(\^?)("*)([A-Za-z0-9_\x1a\x80-\U0010ffff+]+)\5(\*?)')


@dataclass(frozen=True)
class Asked:
    words: tuple[str, ...]
    columns: tuple[str, ...] = tuple(COLUMNS.values())
    first: bool = False  # the first words of a column
    prefix: bool = False  # the last word may go on


def asked(query: str) -> Asked | None:
    """What a query asks for, or None where it is of no known form.

    Several words are a phrase, whatever stands between them. A query without white space
    is ``[[-]column:][^]word[+word...][*]``: in or not in a column (``content``,
    ``message_type``), at its beginning, words that follow one another, a word's beginning.
    """
    if len(query.split()) != 1:
        return Asked(tuple(query_words(query)))
    form = FORM.fullmatch(query.strip())
    if form is None or query.strip() in OPERATORS:
        return None
    but, plain, braced, first, _, words, star = form.groups()
    name, columns = (plain or braced or "").lower(), tuple(COLUMNS.values())
    if name:
        if name not in COLUMNS and name not in UNINDEXED:
            return None
        columns = tuple(c for n, c in COLUMNS.items() if (n == name) != bool(but))
    if not all(words.split("+")):
        return None
    return Asked(tuple(query_words(words)), columns, bool(first), bool(star))


def _indexed(facts: Facts) -> DataFrame:
    return facts.messages.withColumn("terms", F.concat(search_text.words(F.col("role")), search_text.words(F.col("content"))))


def query_words(query: str) -> list[str]:
    table = str.maketrans(search_text.MARKED, search_text.PLAIN)
    return [w for w in re.split(r"[\W_]+", query.lower().translate(table)) if w]


def _occurrences(terms: Column, wanted: list[str]) -> Column:
    """How often the words follow one another; terms are letters and digits only."""
    spaced = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))
    return F.regexp_count(spaced, F.lit(f"(?= {' '.join(wanted)} )"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def scored(hits: DataFrame, every: DataFrame) -> DataFrame:
    """``hits`` (with tf and terms) with ``score``; ``every`` is one row of n and mean."""
    return _scored(hits, every.crossJoin(hits.agg(F.count(F.lit(1)).alias("df"))))


def _scored(hits: DataFrame, every: DataFrame) -> DataFrame:
    both = hits.crossJoin(F.broadcast(every))  # one row of totals
    score = idf(F.col("n"), F.col("df")) * (K1 + 1) * search_text.weight(F.col("tf"), F.col("terms"), F.col("mean"))
    return both.withColumn("score", score).drop("n", "mean", "df", "tf")


def totals(messages: DataFrame, index: Index | None = None) -> DataFrame:
    """One row: the number of messages, and their mean length."""
    if index is None:
        return messages.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("terms").cast("double")).alias("mean"))
    mean = index.terms / index.messages if index.messages else 0.0
    return messages.sparkSession.range(1).select(F.lit(index.messages).cast("long").alias("n"), F.lit(mean).alias("mean"))


def ranked(messages: DataFrame, wanted: list[str]) -> DataFrame:
    """``messages`` (with the list ``terms``) that hold the phrase, with ``score``: its BM25, higher is better."""
    counted = messages.withColumn("tf", _occurrences(F.col("terms"), wanted).cast("double")).withColumn("terms", F.size("terms").cast("double"))
    counted = shared.written(counted, "search-counted")  # texts are taken to words once, for the totals and for the hits
    every = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("terms").alias("mean"), F.count_if(F.col("tf") > 0).alias("df"))
    return _scored(counted.where(F.col("tf") > 0), every)


def stem_is(stems: list[str], place: int, prefix: bool) -> Column:
    last = prefix and place == len(stems) - 1
    return F.startswith("stem", F.lit(stems[place])) if last else F.col("stem") == stems[place]


def phrase_hits(postings: DataFrame, want: Asked) -> DataFrame:
    """(session_key, line_no, role, terms, tf) of messages that hold the stems one after another in a column."""
    stems = [search_text.stem(w) for w in want.words]
    is_ = [stem_is(stems, i, want.prefix) for i in range(len(stems))]
    any_ = is_[0]
    for one in is_[1:]:
        any_ = any_ | one
    rows = postings.where(any_)
    if len(stems) > 1 or want.prefix:  # of one message: its places of a word, or of all words that begin so
        lists = [F.flatten(F.collect_list(F.when(one, F.col(c)))).alias(f"{c}_{i}") for c in want.columns for i, one in enumerate(is_)]
        rows = rows.groupBy(*KEYS, "terms").agg(*lists)
    else:
        rows = rows.select(*KEYS, "terms", *(F.col(c).alias(f"{c}_0") for c in want.columns))

    def times(c: str) -> Column:
        def holds(p: Column) -> Column:
            out = (p == 0) if want.first else F.lit(True)
            for i in range(1, len(stems)):
                out = out & F.array_contains(f"{c}_{i}", p + i)
            return out

        return F.size(F.filter(f"{c}_0", holds)) if want.first or len(stems) > 1 else F.size(f"{c}_0")

    tf = F.lit(0)
    for c in want.columns:
        tf = tf + times(c)
    return rows.select(*KEYS, F.col("terms").cast("double").alias("terms"), tf.cast("double").alias("tf")).where("tf > 0")


def best_of(scores: DataFrame, sessions: DataFrame, limit: int) -> DataFrame:
    """The best of ``scores`` (KEYS, score) with project, session_id and path; equal to six digits is equal."""
    both = scores.select(*KEYS, "score").join(sessions.select("session_key", "project", "session_id", "path"), "session_key")
    return both.orderBy(F.desc(F.round("score", 6)), "path", "line_no", "role").limit(limit)


def best_of_word(facts: Facts, stem: str, sessions: DataFrame, limit: int) -> DataFrame:
    """``best_of`` all hits of one stem, from the heaviest levels down, as far as they may hold one of the best."""
    index, own = facts.index, F.col("stem") == stem
    held = index.levels.where(own).groupBy("level").agg(F.sum("n").alias("n")).where("n > 0")
    counts = {r.level: r.n for r in held.collect()}  # LEVELS at most
    none = facts.postings.limit(0).select(*KEYS, F.lit(0.0).alias("score"))
    if not counts:
        return best_of(none, sessions, limit)
    n, mean, df = index.messages, index.terms / index.messages, sum(counts.values())
    factor = idf(F.lit(n), F.lit(df)) * (K1 + 1)
    top = math.log(1 + (n - df + 0.5) / (df + 0.5)) * (K1 + 1)
    tf = (F.size("in_role") + F.size("in_content")).cast("double")
    score = factor * search_text.weight(tf, F.col("terms").cast("double"), F.lit(mean))
    levels, reach = sorted(counts, reverse=True), limit
    while True:
        low, seen = levels[-1], 0
        for level in levels:
            seen += counts[level]
            if seen >= reach:
                low = level
                break
        best = best_of(facts.postings.where(own & (F.col("level") >= low)).select(*KEYS, score.alias("score")), sessions, limit)
        if low == levels[-1]:
            return best
        rows = best.collect()  # ``limit`` at most
        below = top * search_text.most_below(low, index.typical, mean)
        if len(rows) == limit and round(below * (1 + 1e-9), 6) < round(rows[-1].score, 6):
            return best.sparkSession.createDataFrame(rows, best.schema)
        reach = 4 * seen


@F.pandas_udf(ArrayType(StringType()))
def _stemmed_parts(parts: pd.Series) -> pd.Series:
    """For each part of a text its stems between spaces."""
    one = lambda part: f" {' '.join(map(search_text.stem, query_words(part)))} "
    return parts.map(lambda own: None if own is None else [one(p) for p in own])


def snippet(content: Column, words: list[str], stem: bool = True, prefix: bool = False) -> Column:
    """Twenty words around the first hit of a query's first word; all its words are marked."""
    parts = F.split(content, r"\s+")
    spaced = F.transform(parts, lambda p: F.concat(F.lit(" "), F.array_join(search_text.words(p), " "), F.lit(" ")))
    pairs = F.arrays_zip(parts.alias("word"), (_stemmed_parts(parts) if stem else spaced).alias("held"))
    forms = [w + r"\S*" if prefix and i == len(words) - 1 else w for i, w in enumerate(words)]  # letters and digits
    has = lambda held, some: F.rlike(held, F.lit(f" ({'|'.join(some)}) ")) if some else F.lit(False)
    at = F.coalesce(F.array_position(F.transform(pairs, lambda p: has(p["held"], forms[:1])), True), F.lit(0)).cast("int")
    start = F.greatest(F.lit(1), at - SNIPPET_WORDS // 2)
    mark = lambda p: F.when(has(p["held"], forms), F.concat(F.lit("[["), p["word"], F.lit("]]"))).otherwise(p["word"])
    head = F.when(start > 1, F.lit("...")).otherwise(F.lit(""))
    tail = F.when(start + SNIPPET_WORDS <= F.size(parts), F.lit("...")).otherwise(F.lit(""))
    return F.concat(head, F.array_join(F.transform(F.slice(pairs, start, SNIPPET_WORDS), mark), " "), tail)


def search(facts: Facts, query: str, project: str | None = None, limit: int = LIMIT, stem: bool = True) -> DataFrame:
    """The best messages for a query; ``rank`` is lower for better ones, and equal to six digits is equal.

    A query of no known form finds the lines that contain it, in any case; they have no rank.
    """
    want = asked(query) if stem else Asked(tuple(query_words(query)))
    if want is None:
        lines = literal(facts, query.strip(), project, limit, case_sensitive=False)
        return lines.select("project", "session_id", F.col("date").alias("at"), "role", "snippet", F.lit(None).cast("double").alias("rank"))
    sessions = matching(facts.sessions, project)
    stems = [search_text.stem(w) for w in want.words] if stem else list(want.words)
    plain = len(stems) == 1 and want == Asked(want.words)
    if not want.words or not want.columns:
        best = best_of(facts.messages.select(*KEYS, F.lit(0.0).alias("score")).where(F.lit(False)), sessions, limit)
    elif not stem:
        best = best_of(ranked(_indexed(facts).select(*KEYS, "terms"), stems), sessions, limit)
    elif plain and facts.index is not None:
        best = best_of_word(facts, stems[0], sessions, limit)
    else:
        best = best_of(scored(phrase_hits(facts.postings, want), totals(facts.messages, facts.index)), sessions, limit)
    texts = facts.messages.select(*KEYS, "at", "content")
    shown = F.broadcast(best).join(texts, list(KEYS))  # at most ``limit`` rows
    shown = shown.select("project", "session_id", "at", "role", snippet(F.col("content"), stems, stem, want.prefix).alias("snippet"), "score", "path", "line_no")
    ordered = shown.orderBy(F.desc(F.round("score", 6)), "path", "line_no", "role")
    return ordered.select("project", "session_id", "at", "role", "snippet", (-F.col("score")).alias("rank"))


def literal(facts: Facts, query: str, project: str | None = None, limit: int = LIMIT, case_sensitive: bool = True) -> DataFrame:
    """Lines of messages that contain a text, in order of path and line; a hit a line."""
    lines = facts.messages.select("session_key", "line_no", "role", F.posexplode(F.split("content", "\n")).alias("sub_line", "line"))
    held, wanted = (F.col("line"), query) if case_sensitive else (F.lower("line"), query.lower())
    hits = lines.where(F.contains(held, F.lit(wanted)))
    both = hits.join(matching(facts.sessions, project).select("session_key", "project", "session_id", "path", "first_ms"), "session_key")
    first = both.orderBy("path", "line_no", "role", "sub_line").limit(limit)
    found = F.instr(F.col("line") if case_sensitive else F.lower("line"), wanted)
    start = F.greatest(F.lit(1), found - SIDE)
    end = F.least(F.length("line"), found + len(query) + SIDE - 1)
    text = F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), F.substr("line", start, end - start + 1), F.when(end < F.length("line"), F.lit("...")).otherwise(F.lit("")))
    return first.select("project", "session_id", "line_no", "sub_line", "role", scalars.rfc3339(F.col("first_ms")).alias("date"), text.alias("snippet"))


#: Bytes of files that a literal search of files reads first, and how much more each time.
FIRST_BYTES, GROWTH = 256 << 20, 8


def literal_files(
    spark: SparkSession, root: str, query: str, project: str | None = None, limit: int = LIMIT, case_sensitive: bool = True, first_bytes: int = FIRST_BYTES, **layout: object
) -> DataFrame:
    """``literal`` on transcript files, without a store: files are read in order of path, some
    at first and then ever more, until there are ``limit`` lines. ``layout`` is that of ``read_lines``."""
    files = store.listing(spark, root, **{k: v for k, v in layout.items() if k in ("glob", "name")})
    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    # A row a file, and no more of them than a reader holds on the driver in any case.
    files = files.select("path", F.coalesce(F.sum("file_size").over(order), F.lit(0)).alias("before"))
    with shared.small_files(spark):
        files = shared.written(files, "search-files")
    found, start, size, count = None, 0, first_bytes, files.count()
    while True:
        paths = [store.literal(r.path) for r in files.where((F.col("before") >= start) & (F.col("before") < start + size)).select("path").collect()]
        count -= len(paths)
        f = transcripts.facts(transcripts.records(transcripts.read_lines(spark, root, paths=paths, **layout), whole=False))
        own = literal(f, query, project, limit, case_sensitive).select("*", F.monotonically_increasing_id().alias("place"))
        rows = own.orderBy("place").drop("place").collect()  # ``limit`` at most
        found = rows if found is None else [*found, *rows]
        if len(found) >= limit or count <= 0:
            schema = own.drop("place").schema
            return spark.createDataFrame(found[:limit], schema)
        start, size = start + size, size * GROWTH
