"""Personal data: base patterns, and terms that give a protected entity away.

Base spans (kinds ``email``, ``ip``, ``card``, ``phone``) are found by patterns
with checks. Every distinct value found is a protected entity, and so is each kind
as a whole, as most values occur in one or two texts only. From the whole corpus
come two counts: how many texts hold both a term and an entity, and how many hold
the term at all. Copies of a text count once, with personal data or without, so no
number of copies makes a word disclose anything or hides that it does. Terms are all words, short ones and those with
digits too, but function words. The quotient of the counts, smoothed by ``prior``
texts at the rate of the corpus, is P(entity | term); its logarithm against
P(entity) is what the term discloses, in bits. A term is sanitised where it meets
one entity or kind in at least ``support`` different texts and discloses at least
``bits``: removed where P(entity | term) reaches ``remove``, generalised to its
length class where it reaches ``generalise``. A term of one or two texts can meet
an entity there by chance, so it is not sanitised.

One scan finds the base spans and counts words, a second finds the disclosing
terms. Before the first, digests tell which texts occur more than once: the words of
those are passed on by text and counted after copies are dropped, all others are added
up in the tasks, so no text is shuffled. Tasks know the repeated digests, and those of
the second scan the terms, by a sieve whose size is bounded; they pass on what it
cannot rule out, and a join or an aggregation decides. Rows of a frequent entity or
term are dealt into salted parts; texts with the same frequent
entities count their terms together before pairs are made. The plan is the same for few and many terms.

A null or empty text has no spans. A text of any length is scanned whole, in time
in proportion to it. Spans that tie in start are listed by kind, then end. Equal
rows give equal results; an empty table gives an empty result; other columns are
not read by ``find`` and kept by ``sanitise``, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPARK_SEED, passes, sieve, slices, table, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match takes whole runs of digits, so it can only begin where one begins.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]")
TERM = re.compile(r"[^\W_]+")
#: Words that name nothing, whatever they stand beside.
FUNCTION_WORDS = frozenset(
    "a an and are as at be but by can did do does for from had has have he her hers him his i if in is it its may me my no nor not of on or our ours shall she should so than that the their theirs them then these they this those to up us was we were what when where which who whom whose will with would you your yours".split()
)
PRIOR = 1.0
SUPPORT, BITS, GENERALISE, REMOVE = 3, 4.0, 0.5, 0.9
#: 64-bit words of the sieve of terms; None: as their number asks.
SIEVE_WORDS = None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def octet(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign back over the local part: linear, unlike a search from every character."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else NOT_DIGITS.sub('', value)}"


def terms_beside(text: str, found: list[tuple[str, int, int]]) -> set[str]:
    """Lower-cased terms of a whole text; words that touch a base span are left out."""
    taken = bytearray(len(text))
    for _, a, b in found:
        taken[a:b] = b"\x01" * (b - a)
    return {m[0].lower() for m in TERM.finditer(text) if taken.find(1, m.start(), m.end()) < 0} - FUNCTION_WORDS


def words_of(text: str) -> set[str]:
    return set(TERM.findall(text.lower())) if text.isascii() else {w.lower() for w in TERM.findall(text)}


PASS_SCHEMA = """
    doc_id long, text_print string, spans array<struct<kind:string,start:int,end:int>>,
    entities array<string>, terms array<string>, word string, rows long
"""
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
PASS_KINDS = {
    "doc_id": pa.int64(),
    "text_print": pa.string(),
    "spans": pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),
    "entities": pa.list_(pa.string()),
    "terms": pa.list_(pa.string()),
    "word": pa.string(),
    "rows": pa.int64(),
}
#: Words that a task counts before it passes them on.
COUNTED = 500_000


def repeated(docs: DataFrame) -> np.ndarray:
    """A sieve of the digests of texts that occur more than once; ``docs`` as by ``printed``."""
    digests = docs.groupBy("text_print").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sieve(written(digests.select(F.xxhash64("text_print").alias("hash")), "pii-repeated"))


def first_pass(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two sorts of rows from one scan: of every text its base spans and entities, and
    all its terms where it has any or may occur again; and (word, rows), how many of the
    other texts hold a word, added up as they come."""
    texts = printed(docs, key, text)
    copies = docs.sparkSession.sparkContext.broadcast(repeated(texts))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: Counter[str] = Counter()
        passed_on: set[str] = set()
        for batch in batches:
            for piece in slices(batch, 2):
                rows = []
                keys, prints, texts_ = (c.to_pylist() for c in piece.columns)
                many = held_by(copies.value, prints)
                for key_, print_, text in zip(keys, prints, texts_):
                    found, terms = base_matches(text), []
                    if found:
                        terms = sorted(terms_beside(text, found))
                    elif print_ not in many:
                        plain.update(words_of(text))
                    elif print_ not in passed_on:  # once a task is enough
                        terms = sorted(words_of(text))
                        passed_on.add(print_)
                    rows.append({
                        "doc_id": key_,
                        "text_print": print_,
                        "spans": [{"kind": k, "start": a, "end": b} for k, a, b in found],
                        "entities": sorted({entity(k, text[a:b]) for k, a, b in found}),
                        "terms": terms,
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(PASS_KINDS))
                if len(plain) > COUNTED:
                    yield counted(plain)
                    plain = Counter()
                if len(passed_on) > COUNTED:
                    passed_on = set()
        yield counted(plain)

    def counted(plain: Counter[str]) -> pa.RecordBatch:
        own = {"word": pa.array(list(plain), pa.string()), "rows": pa.array(list(plain.values()), pa.int64())}
        columns = [own.get(name, pa.nulls(len(plain), kind)) for name, kind in PASS_KINDS.items()]
        return pa.RecordBatch.from_arrays(columns, names=list(PASS_KINDS))

    return texts.mapInArrow(scan, PASS_SCHEMA)


def printed(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return text_or_empty(own).select("doc_id", F.md5("text").alias("text_print"), "text")


WORDS_SCHEMA = "doc_id long, text_print string, term string, spans array<struct<start:int,end:int>>"


def term_spans(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_print, term, spans) of the terms in each text, and of a few other
    words: those that a sieve cannot tell from a term."""
    bits = docs.sparkSession.sparkContext.broadcast(sieve(terms.select(F.xxhash64("term").alias("hash")), SIEVE_WORDS))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(bits.value)
        kinds = [("doc_id", pa.int64()), ("text_print", pa.string()), ("term", pa.string()), ("spans", pa.list_(SPAN))]
        for batch in batches:
            for piece in slices(batch, 2):
                rows = []
                for key_, print_, text in zip(*(c.to_pylist() for c in piece.columns)):
                    if not (wanted := known.among(words_of(text))):
                        continue
                    own: dict[str, list[dict]] = {}
                    for m in TERM.finditer(text):
                        term = m[0].lower()
                        if term in wanted:
                            own.setdefault(term, []).append({"start": m.start(), "end": m.end()})
                    rows += [{"doc_id": key_, "text_print": print_, "term": t, "spans": s} for t, s in own.items()]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return printed(docs, key, text).mapInArrow(find, WORDS_SCHEMA)


def held_by(bits: np.ndarray, values: list[str]) -> set[str]:
    """Those of the values that pass a sieve of Spark's ``xxhash64``."""
    hashes = np.array([xxhash.xxh64_intdigest(v, seed=SPARK_SEED) for v in values], np.uint64)
    return {v for v, in_ in zip(values, passes(bits, hashes)) if in_}


class Known:
    """Which words pass a sieve; the words met before are remembered."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.met: set[str] = set()
        self.passed: set[str] = set()

    def among(self, words: set[str]) -> set[str]:
        if len(self.met) > COUNTED:
            self.met, self.passed = set(), set()
        if new := list(words - self.met):
            self.met.update(new)
            self.passed.update(held_by(self.bits, new))
        return words & self.passed


#: Parts into which rows of one entity or term are dealt, so that a frequent one is no task of its own.
SALT = 32


def salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))


def in_every_part(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def disclosure(
    passed: DataFrame, support: int = SUPPORT, bits: float = BITS, generalise: float = GENERALISE, remove: float = REMOVE, prior: float = PRIOR
) -> DataFrame:
    """(term, action, given, bits) of the terms to sanitise, from the written ``first_pass``."""
    held = passed.where(F.size("entities") > 0).select("text_print", "entities", "terms").dropDuplicates(["text_print"])
    held = written(held, "pii-texts")
    bare = passed.where("word is null and size(entities) = 0")
    texts = held.count() + bare.select("text_print").distinct().count()

    # No term meets an entity more often than it occurs, so rare entities need no pairs.
    each = held.select(F.explode("entities").alias("entity"), "text_print")
    often = each.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_texts")).where(F.col("entity_texts") >= support)
    met = salted(each, "text_print").join(in_every_part(often), ["entity", "salt"]).groupBy("text_print")
    met = met.agg(F.array_sort(F.collect_list(F.struct("entity", "entity_texts"))).alias("often"))  # of one text
    by_set = met.join(held.select("text_print", "terms"), "text_print").select("often", F.explode("terms").alias("term"))
    by_set = by_set.groupBy("often", "term").agg(F.count(F.lit(1)).alias("n"))
    by_entity = by_set.select("term", "n", F.inline("often")).groupBy("term", "entity")
    near = by_entity.agg(F.sum("n").alias("together"), F.max("entity_texts").alias("entity_texts"))

    own = F.array_distinct(F.transform("entities", lambda e: F.substring_index(e, ":", 1)))
    kinds = held.select(F.explode(own).alias("entity"), "terms")
    of_kinds = F.broadcast(kinds.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_texts")))  # a row a kind
    by_kind = kinds.select("entity", F.explode("terms").alias("term")).groupBy("term", "entity")
    by_kind = by_kind.agg(F.count(F.lit(1)).alias("together")).join(of_kinds, "entity")
    near = written(near.unionByName(by_kind).where(F.col("together") >= support), "pii-near")

    counts = passed.where("word is not null").select(F.col("word").alias("term"), "rows")
    again = bare.where(F.size("terms") > 0).select("text_print", "terms").dropDuplicates(["text_print"])
    for some in (held, again):
        counts = counts.unionByName(some.select(F.explode("terms").alias("term"), F.lit(1).cast("long").alias("rows")))
    counts = counts.groupBy("term").agg(F.sum("rows").alias("texts"))
    rate = F.col("entity_texts") / F.lit(float(max(texts, 1)))
    given = (F.col("together") + prior * rate) / (F.col("texts") + prior)
    told = near.join(counts, "term").withColumn("given", given).withColumn("bits", F.log2(F.col("given") / rate))
    strong = told.where((F.col("given") >= generalise) & (F.col("bits") >= bits))
    action = F.when(F.max("given") >= remove, F.lit("remove")).otherwise(F.lit("generalise"))
    actions = strong.groupBy("term").agg(action.alias("action"), F.max("given").alias("given"), F.max("bits").alias("bits"))
    return written(actions, "pii-actions")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits: float) -> DataFrame:
    """(doc_id, text_print, base, terms): all spans of every text; a term span has its action."""
    passed = written(first_pass(docs, key, text), "pii-base")
    actions = disclosure(passed, **limits)
    used = salted(term_spans(docs, actions, key, text), "text_print").join(in_every_part(actions), ["term", "salt"])
    spans = used.select("doc_id", "text_print", "action", F.explode("spans").alias("s"))
    # A row a document; equal texts of equal ids have equal terms, so they count once.
    ordered = F.array_sort(F.collect_set(F.struct("s.start", "s.end", "action")))
    own = spans.groupBy("doc_id", "text_print").agg(ordered.alias("terms"))
    found = passed.where("word is null")
    same = found["doc_id"].eqNullSafe(own["doc_id"]) & (found["text_print"] == own["text_print"])
    joined = found.join(own, same, "left").select(found["doc_id"].alias(key), found["text_print"], found["spans"].alias("base"), own["terms"])
    none = F.expr("cast(array() as array<struct<start:int,end:int,action:string>>)")
    # Inside a base span a term is hidden already.
    apart = F.filter(F.coalesce("terms", none), lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.withColumn("terms", F.when(F.size("base") > 0, apart).otherwise(F.coalesce("terms", none)))


def sanitise(docs: DataFrame, **limits: float) -> DataFrame:
    """``docs`` with base spans replaced by their kind and disclosing terms removed or
    generalised to a length class; all columns and rows stay."""
    spans = find(docs.select("doc_id", "text"), **limits)
    hidden = spans.where((F.size("base") > 0) | (F.size("terms") > 0)).select("doc_id", "text_print", "base", "terms").dropDuplicates(["doc_id", "text_print"])
    # The rows travel as structs, so their columns can have any names.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("print"))
    both = rows.join(hidden, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("print") == F.col("text_print")), "left")

    @F.pandas_udf("string")
    def rewrite(texts, base, terms):
        import pandas as pd

        out = []
        for text, b, t in zip(texts, base, terms):
            if text is None or b is None:
                out.append(text)
                continue
            edits = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in b]
            edits += [(s["start"], s["end"], "" if s["action"] == "remove" else f"[WORD{min(9, (s['end'] - s['start']) // 4)}]") for s in t]
            parts, at = [], 0
            for begin, end, new in sorted(edits):
                if begin >= at:  # base spans of different kinds can overlap
                    parts += [text[at:begin], new]
                at = max(at, end)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    return both.withColumn("text", rewrite("row.text", "base", "terms")).select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of disclosing terms in every document."""
    found = find(table(spark, sf_dir, "documents"))
    terms = F.array_join(F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = (F.size(F.filter("base", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS)
    every = F.array_join(F.filter(F.array(listed(F.col("base")), terms), lambda x: x != ""), ",")
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), every.alias("spans"))


QUERIES = {"op6_pii": op6_pii}
ORACLE: dict[str, str] = {}
