"""Repair of conversation structure: the cheapest edits to ``s?(ua)+`` or to nothing.

Turns of a conversation are put in order and marked with their first fault: blank,
duplicate, truncated. A turn's symbol stands for the initial of its role and its fault;
a conversation's symbols are its signature, in blocks of at most ``BLOCK`` turns. The
repair is a dynamic programme over four states (nothing yet, after s, after u, after a),
with the least cost and the least string of edits for each:

* Blocks are dealt in ranges of sorted signatures, so equal ones lie side by side even
  where they fill several tasks. A task walks its blocks as the paths of a prefix trie:
  a layer of the programme is computed once for all signatures that share the prefix,
  and an answer is given wherever one ends.
* ``chained`` joins the answers of a conversation's blocks in order. Most have one.

Turns are ordered by ``repartitionByRange``, so a conversation that holds a third of all
turns fills many tasks. Only its digest, which is a chain by nature, is computed by one
task from a stream of turns; nothing collects a conversation.

Ties in turn are ordered by role and text; null turns come first; rows that are equal
are rows. A null conversation is one of its own and keeps its null. A null role or text
is one space, and so blank. A role without characters has no initial: it may be kept
anywhere. Texts of any length are streamed, not gathered. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written

BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: States, what each expects next, and those a conversation may end in.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
EXPECTED = ("u", "u", "a", "u")
AFTER = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
ENDS = (START, AFTER_A)
FAULTS = ("", "blank", "duplicate", "truncated")
#: Initials that symbols tell apart: no character at all, and any other one.
INITIALS = ("s", "u", "a", "", "?")
ROLES = {"u": "user", "a": "assistant"}
FILLED, SENTENCE_END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

Layer = list[tuple[int, str] | None]


def symbol(initial: str, fault: int) -> str:
    return chr(ord("A") + INITIALS.index(initial if initial in INITIALS else "?") * len(FAULTS) + fault)


SYMBOLS = {symbol(i, f): (i, f) for i in INITIALS for f in range(len(FAULTS))}


def with_inserts(layer: Layer) -> Layer:
    """Every state also by inserted turns, where that is cheaper or as cheap and its edits come first."""
    state, changed = list(layer), True
    while changed:
        changed = False
        for here in range(4):
            if state[here] is not None:
                there = AFTER[EXPECTED[here]]
                made = (state[here][0] + INSERT, state[here][1] + "I")
                if state[there] is None or made < state[there]:
                    state[there], changed = made, True
    return state


def step(layer: Layer, mark: str) -> Layer:
    """The layer after one more turn."""
    initial, fault = SYMBOLS[mark]
    out: Layer = [None] * 4

    def offer(state: int, cost: int, edits: str) -> None:
        if out[state] is None or (cost, edits) < out[state]:
            out[state] = cost, edits

    for here, held in enumerate(layer):
        if held is None:
            continue
        cost, edits = held
        offer(here, cost + DELETE, edits + "D")
        if FAULTS[fault] in ("blank", "duplicate"):
            continue
        extra = UNFINISHED if FAULTS[fault] == "truncated" else 0
        offer(AFTER[EXPECTED[here]], cost + REROLE + extra, edits + "R")
        if initial == "":
            offer(here, cost + KEEP + extra, edits + "K")
        elif initial == EXPECTED[here] or (initial == "s" and here == START):
            offer(AFTER[initial], cost + KEEP + extra, edits + "K")
    return with_inserts(out)


def trie_answers(signatures: Iterator[tuple[bool, str]]) -> Iterator[list[Layer]]:
    """For each (whether it begins a conversation, signature) the layers at its end: by start
    state, only the first for a beginning. Sorted signatures share the layers of prefixes."""
    path, layers, began = "", [], None
    for begins, signature in signatures:
        if begins != began:
            starts = (START,) if begins else range(4)
            path, layers, began = "", [[with_inserts([(0, "") if s == k else None for s in range(4)]) for k in starts]], begins
        shared = 0
        while shared < min(len(path), len(signature)) and path[shared] == signature[shared]:
            shared += 1
        del layers[shared + 1 :]
        for mark in signature[shared:]:
            layers.append([step(layer, mark) for layer in layers[-1]])
        path = signature
        yield layers[-1]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 256).columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, tie): rows after the damage that their own numbers choose, see ``op13_repair``."""
    one = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), one).alias("role"), F.coalesce(F.col("text").cast("string"), one).alias("text")
    )
    name = F.concat(F.coalesce(F.col("conv").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    rows = rows.withColumn("kind", F.crc32(name.cast("binary")) % 20).where("kind <> 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.struct("role", "text", "copy").alias("tie"))


def ordered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``id``, rising in a conversation by turn and tie; written."""
    spark = turns.sparkSession
    keys = ("conv", "turn", "tie")
    dealt = turns.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    return written(dealt.select("conv", F.monotonically_increasing_id().alias("id"), "turn", "role", "text"), "repair-turns")


def signatures(turns: DataFrame) -> DataFrame:
    """(conv, block, begins, signature) of ordered turns, written."""
    kept = turns.select("conv", "id", F.substring("role", 1, 1).alias("initial"), F.rlike("text", F.lit(FILLED)).alias("filled"), F.rlike("text", F.lit(SENTENCE_END)).alias("ended"), F.sha2(F.concat_ws("\n", F.length("role"), "role", "text"), 256).alias("said"))
    first = kept.groupBy("conv", "said").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("said").alias("s"), "first")
    marked = kept.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    fault = F.when(~F.col("filled"), 1).when(F.col("id") > F.col("first"), 2).when(~F.col("ended"), 3).otherwise(0)
    place = F.lit(INITIALS.index("?"))
    for i in INITIALS[:-1]:
        place = F.when(F.col("initial") == i, INITIALS.index(i)).otherwise(place)
    marks = marked.select("conv", "id", F.shiftright("id", BLOCK_BITS).alias("block"), F.char(F.lit(ord("A")) + place * len(FAULTS) + fault).alias("mark"))
    listed = F.array_sort(F.collect_list(F.struct("id", "mark")))  # of one block
    blocks = marks.groupBy("conv", "block").agg(F.array_join(F.transform(listed, lambda x: x["mark"]), "").alias("signature"))
    blocks = written(blocks, "repair-blocks")
    firsts = blocks.groupBy("conv").agg(F.min("block").alias("least")).withColumnRenamed("conv", "c")
    both = blocks.join(firsts, F.col("conv").eqNullSafe(F.col("c")))
    return both.select("conv", "block", (F.col("block") == F.col("least")).alias("begins"), "signature")


ANSWERS = "conv long, block long, signature string, costs array<long>, edits array<string>"


def answered(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the least cost and edits by start and end state, four a start; null where there is no way."""
    keys = ("begins", "signature", "conv", "block")
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("signature", pa.string()), ("costs", pa.list_(pa.int64())), ("edits", pa.list_(pa.string()))])

        def rows() -> Iterator[tuple]:
            held: list[tuple] = []

            def given() -> Iterator[tuple[bool, str]]:
                for begins, signature, conv, block in _streamed(batches):
                    held.append((conv, block, signature))
                    yield begins, signature

            for layers in trie_answers(given()):
                cells = [cell or (None, None) for layer in layers for cell in layer]
                yield *held.pop(), [c for c, _ in cells], [e for _, e in cells]

        return _batches(rows(), schema, 100)

    return blocks.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(walk, ANSWERS)


def chained(answers: DataFrame) -> DataFrame:
    """(conv, block, signature, edits, cost) of every block: the edits of the cheapest repair
    of its conversation, of equal ones the least, and at each conversation's first block the cost."""
    schema = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("signature", pa.string()), ("edits", pa.string()), ("cost", pa.int64())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, held, best = None, [], []

            def ended() -> Iterator[tuple]:
                cost, _, parts = min(best[s] for s in ENDS if best[s] is not None)
                for k, ((block, signature), part) in enumerate(zip(held, parts)):
                    yield now[0], block, signature, part, None if k else cost

            for conv, block, signature, costs, edits in _streamed(batches):
                if now != (conv,):
                    if now:
                        yield from ended()
                    now, held, best = (conv,), [], [(0, "", ()), None, None, None]
                out = [None] * 4
                for start in range(len(costs) // 4):
                    for end in range(4):
                        cost, made = costs[4 * start + end], edits[4 * start + end]
                        if best[start] is not None and cost is not None:
                            was = best[start]
                            found = (was[0] + cost, was[1] + made, (*was[2], made))
                            out[end] = found if out[end] is None else min(out[end], found)
                best = out
                held.append((block, signature))
            if now:
                yield from ended()

        return _batches(rows(), schema)

    return answers.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(chain, "conv long, block long, signature string, edits string, cost long")


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LINES = "conv_id long, place long, role string, text string"


class Telling:
    """One pass over rows of ``told``: at each conversation's end its counts, and its repaired turns on the way."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows = rows
        self.row = next(rows, None)

    def _is(self, kind: int) -> bool:
        return self.row is not None and self.row[0] == self.conv and self.row[2] == kind

    def _turns(self) -> Iterator[tuple[str, str]]:
        while self._is(2):
            turn, role, text = self.row[3:6]
            self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
            self.last = role[:1]
            if turn is not None:
                self.known += turn != self.most
                self.least, self.most = turn if self.least is None else self.least, turn
            self.row = next(self.rows, None)
            yield role, text

    def conversations(self) -> Iterator[Iterator[tuple[str, str]]]:
        """The repaired turns of each conversation; a reader takes them all before the next."""
        while self.row is not None:
            self.conv, self.counts, self.audit, self.cost = self.row[0], [0] * len(FAULTS), [], 0
            self.illegal, self.known, self.last, self.least, self.most = 0, 0, None, None, None
            self.row = next(self.rows, None)
            yield self._repaired()

    def _repaired(self) -> Iterator[tuple[str, str]]:
        state = START
        while self._is(1):
            signature, edits, cost = self.row[4:7]
            self.row = next(self.rows, None)
            self.cost += cost or 0
            self.audit.append(edits)
            for mark in signature:
                self.counts[SYMBOLS[mark][1]] += 1
            turns = self._turns()
            for edit in edits:
                role, text = ("", "") if edit == "I" else next(turns)
                if edit != "D":
                    role = ROLES[EXPECTED[state]] if edit in "RI" else role
                    state = AFTER.get(role[:1], state)
                    yield role, text
            if self._is(2):
                raise ValueError("more turns than edits")

    def result(self, digest: str) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.known
        return self.conv, gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.audit), digest


def told(convs: DataFrame, turns: DataFrame, blocks: DataFrame, lines: bool = False) -> DataFrame:
    """A row for each of ``convs``: counts over its ``turns`` and the digest of what the edits of
    ``blocks`` make of them; or, with ``lines``, a row for each repaired turn."""
    none = lambda kind: F.lit(None).cast(kind)
    at = lambda c: c.cast("long").alias("at")
    head = convs.select("conv", at(F.lit(-1)), F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("a"), none("string").alias("b"), none("long").alias("cost"))
    block = blocks.select("conv", at(F.shiftleft("block", BLOCK_BITS)), F.lit(1).alias("kind"), none("long").alias("turn"), F.col("signature").alias("a"), F.col("edits").alias("b"), "cost")
    turn = turns.select("conv", at(F.col("id")), F.lit(2).alias("kind"), "turn", F.col("role").alias("a"), F.col("text").alias("b"), none("long").alias("cost"))
    every = head.unionByName(block).unionByName(turn).repartition("conv").sortWithinPartitions("conv", "at", "kind")
    names = LINES if lines else RESULT
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in names.split(", ")])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = Telling(_streamed(batches))

        def written_lines() -> Iterator[tuple]:
            for own in telling.conversations():
                for place, (role, text) in enumerate(own):
                    yield telling.conv, place, role, text

        def results() -> Iterator[tuple]:
            for own in telling.conversations():
                sha = hashlib.sha256()
                for place, said in enumerate(own):
                    sha.update(("\n" * (place > 0) + ":".join(said)).encode())
                yield telling.result(sha.hexdigest())

        return _batches(written_lines() if lines else results(), schema)

    small_batches(turns.sparkSession)
    return every.mapInArrow(tell, names)


def repaired(conversations: DataFrame, damage: Callable[[DataFrame], DataFrame] | None = None, lines: bool = False) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every
    conversation in ``conversations`` (conv_id, turn, role, text), after ``damage`` if one is
    given; with ``lines`` the repaired turns themselves, (conv_id, place, role, text)."""
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    turns = ordered(damage(conversations) if damage else plain.withColumn("tie", F.struct("role", "text")))
    blocks = written(chained(answered(signatures(turns))), "repair-edits")
    return told(plain.select("conv").distinct(), turns, blocks, lines)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by crc32 of ``conv_id:turn`` modulo 20 (0 drops a row, 1 empties
    its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's), and repaired."""
    return repaired(table(spark, sf_dir, "conversations"), damaged)


QUERIES = {"op13_repair": op13_repair}
#: Row by row in a recursive query: the least (cost, edits) of each state, then the repaired lines edit by edit.
ORACLE = {
    "op13_repair": r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step
), raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, step,
        list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations, crc
), kinds AS (
    SELECT * EXCLUDE (bytes, step), xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind FROM raw
), damaged AS (
    SELECT conv_id, turn, role AS was, text AS said, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kinds WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, was, said, copy) AS i FROM damaged
), repeats AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM placed
), turns AS (
    SELECT conv_id, turn, i, role, text, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM repeats
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM turns GROUP BY conv_id
), states AS (
    SELECT conv_id, 0::BIGINT AS i, {c: 0, e: ''} AS z, {c: 1000000000, e: ''} AS s, {c: 3, e: 'I'} AS u, {c: 6, e: 'II'} AS a FROM counts
    UNION ALL SELECT conv_id, i, z, s, v, list_sort([a, {c: v.c + 3, e: v.e || 'I'}])[1] FROM (
        SELECT conv_id, i, z, s, list_sort([u, {c: z.c + 3, e: z.e || 'I'}, {c: s.c + 3, e: s.e || 'I'}, {c: a.c + 3, e: a.e || 'I'}])[1] AS v, a FROM (
            SELECT p.conv_id, t.i,
                list_sort([{c: z.c + 4, e: z.e || 'D'}, {c: z.c + CASE WHEN keep AND r = '' THEN x ELSE 1000000000 END, e: z.e || 'K'}])[1] AS z,
                list_sort([{c: s.c + 4, e: s.e || 'D'}, {c: s.c + CASE WHEN keep AND r = '' THEN x ELSE 1000000000 END, e: s.e || 'K'}, {c: z.c + CASE WHEN keep AND r = 's' THEN x ELSE 1000000000 END, e: z.e || 'K'}])[1] AS s,
                list_sort([{c: u.c + 4, e: u.e || 'D'}, {c: u.c + CASE WHEN keep AND r = '' THEN x ELSE 1000000000 END, e: u.e || 'K'},
                    {c: z.c + CASE WHEN keep AND r = 'u' THEN x ELSE 1000000000 END, e: z.e || 'K'}, {c: s.c + CASE WHEN keep AND r = 'u' THEN x ELSE 1000000000 END, e: s.e || 'K'},
                    {c: a.c + CASE WHEN keep AND r = 'u' THEN x ELSE 1000000000 END, e: a.e || 'K'}, {c: z.c + CASE WHEN keep THEN x + 3 ELSE 1000000000 END, e: z.e || 'R'},
                    {c: s.c + CASE WHEN keep THEN x + 3 ELSE 1000000000 END, e: s.e || 'R'}, {c: a.c + CASE WHEN keep THEN x + 3 ELSE 1000000000 END, e: a.e || 'R'}])[1] AS u,
                list_sort([{c: a.c + 4, e: a.e || 'D'}, {c: a.c + CASE WHEN keep AND r = '' THEN x ELSE 1000000000 END, e: a.e || 'K'},
                    {c: u.c + CASE WHEN keep AND r = 'a' THEN x ELSE 1000000000 END, e: u.e || 'K'}, {c: u.c + CASE WHEN keep THEN x + 3 ELSE 1000000000 END, e: u.e || 'R'}])[1] AS a
            FROM states p JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS keep, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS x FROM turns) t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1))
), best AS (
    SELECT c.conv_id, list_sort([z, a])[1] AS b FROM states p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i
), repaired AS (
    SELECT conv_id, b.e AS audit, 1 AS p, 0::BIGINT AS i, '' AS state, ''::VARCHAR AS lines, 0 AS n FROM best
    UNION ALL SELECT conv_id, audit, p + 1, i + CASE edit WHEN 'I' THEN 0 ELSE 1 END, CASE WHEN edit = 'D' OR role = '' THEN state ELSE left(role, 1) END,
        CASE WHEN edit = 'D' THEN lines ELSE lines || CASE WHEN n > 0 THEN chr(10) ELSE '' END || role || ':' || text END, n + CASE edit WHEN 'D' THEN 0 ELSE 1 END FROM (
            SELECT q.conv_id, audit, p, q.i, state, lines, n, audit[p] AS edit, CASE WHEN audit[p] IN ('I', 'R') THEN CASE state WHEN 'u' THEN 'assistant' ELSE 'user' END ELSE t.role END AS role,
                CASE audit[p] WHEN 'I' THEN '' ELSE t.text END AS text
            FROM repaired q LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM q.conv_id AND t.i = q.i + 1 WHERE p <= length(audit))
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.e, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired q ON q.conv_id IS NOT DISTINCT FROM o.conv_id AND q.p = length(q.audit) + 1
""",
}
