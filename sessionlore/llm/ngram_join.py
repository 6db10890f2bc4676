"""N-gram Jaccard join of all documents with a prefix tree.

A document's set holds its distinct word 5-grams as 64-bit hashes (a shorter
text: its whole word sequence as one). Two documents link when 100 * overlap >=
75 * union. The join is exact; what narrows it are bounds that every linked pair
keeps:

*Prefix counts.* With sets in one global order (of hash values), a set of n with
lo = ceil(0.75 n) shares at least k elements with any partner inside the first
n - lo + k of each. An element that only one document has in its prefix is dead;
a document whose prefix has fewer than k live elements links with nothing. k
grows with n, so common lines and licence texts alone keep nobody. Dead elements
are found by one aggregation (count and smallest owner), so frequent n-grams are
combined before they are shuffled and never listed. A first pass takes all
documents with a short prefix; a second one takes one document for each set that
is left, with a longer one.

*Rarest live elements.* Of a document's L live prefix elements any partner shares
k, so it shares one of the L - k + 1 rarest. Documents that have one of these in
common are connected; the connected components hold all possible links.

*Tiles of tries.* A component is divided by size class (partners differ by 4/3
at most) and hashed blocks, and pairs of blocks are joined in a task each. One
block is stored as a trie of its globally ordered sets, frequent elements first,
with unbranched paths as one edge. The traversal carries the overlaps with all
sets of the other block, so sets that begin alike share that work, and leaves a
subtree where no partner can still reach its threshold with what remains of
either set. A task returns a row a document: its links and the smallest document
it reaches; never its pairs.

Equal sets are one node with a count. Rows that share a doc_id are one node; a
null doc_id and texts without words link with nothing. A text of any length gives
its whole set. Pairs that tie with the threshold link; of elements that tie in
count the smaller hash is rarer. An empty table gives an
empty result. Other columns are not read by the join; ``deduplicated`` keeps
them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, written
from .graph import components, roots

N = 5
#: Overlap over union, as a fraction of whole numbers.
THRESHOLD = (75, 100)
#: One further prefix element for every so many of the set, in the two passes.
FIRST, SECOND = 16, 4
#: Documents and elements of a block.
BLOCK_DOCS, BLOCK_ELEMENTS = 256, 120_000

_WORD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_powers = np.ones(1, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int = N) -> np.ndarray:
    """The sorted set of hashed word n-grams; words end at ASCII white space and A-Z are lowered."""
    global _powers
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inner = np.flatnonzero(~space)
    if not len(inner):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(inner, prepend=-2) > 1)  # of each word, in ``inner``
    data = data[inner]
    data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    lengths = np.diff(np.append(first, len(inner)))
    if (longest := int(lengths.max())) > len(_powers):
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * longest, _WORD)]))
    place = np.arange(len(inner)) - np.repeat(first, lengths)
    words = _mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _powers[place], first) + lengths.astype(np.uint64))
    width = min(n, len(words))
    held = words[: len(words) - width + 1].copy()
    for i in range(1, width):
        held = held * _WORD + words[i : len(words) - width + 1 + i]
    return np.unique(_mixed(held + np.uint64(width)).view(np.int64))


def least_partner(n: int) -> int:
    """The fewest elements that a set of n shares with any partner, and the smallest size of one."""
    return -(-n * THRESHOLD[0] // THRESHOLD[1])


def needed(n: int, every: int) -> int:
    """Live prefix elements that a set of n shares with any partner (which has lo elements or more)."""
    return 1 + least_partner(n) // every


def prefix(n: int, every: int) -> int:
    return min(n, n - least_partner(n) + 1 + n // every)


def sets(docs: DataFrame, make: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """(doc_id, text_print, n, print, elements) of each text; ``make`` chooses the elements to return."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                made = [shingles(t) for t in some.column(2).to_pylist()]
                kept = [make(s) for s in made] if make else []
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in kept])]) if make else np.zeros(len(made) + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        some.column(1),
                        pa.array([len(s) for s in made], pa.int32()),
                        pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in made], pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(kept) if kept else np.zeros(0), pa.int64())),
                    ],
                    names=["doc_id", "text_print", "n", "print", "elements"],
                )

    own = text_or_empty(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = own.select("doc_id", F.xxhash64("text").alias("text_print"), "text")
    return rows.mapInArrow(apply, "doc_id long, text_print long, n int, print string, elements array<long>")


def head(every: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda s: s[: prefix(len(s), every)]


def _column(every: int, what: Callable[[int], int] | str) -> Column:
    """``needed`` or ``prefix`` of the column n, as an expression."""
    lo = F.ceil(F.col("n") * THRESHOLD[0] / THRESHOLD[1])
    if what == "needed":
        return F.floor(lo / every) + 1
    return F.least(F.col("n").cast("long"), F.col("n") - lo + 1 + F.floor(F.col("n") / every))


def survivors(own: DataFrame, nodes: DataFrame, every: int) -> DataFrame:
    """Those of ``nodes`` (doc_id, n, print) that keep enough live elements in their prefixes ``own``."""
    node = F.xxhash64("doc_id", "print").alias("node")  # tells different texts of one id apart
    owners = own.select(node, F.explode("elements").alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
    dead = owners.where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("dead"))
    live = _column(every, "prefix") - F.coalesce("dead", F.lit(0))
    return nodes.select("*", node).join(dead, "node", "left").where(live >= _column(every, "needed")).select("doc_id", "n", "print")


def chosen(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``texts`` whose id is in ``ids``: both are shuffled by id, whatever their number, and the narrow side is hashed."""
    return texts.join(ids.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")


def candidates(docs: DataFrame, ids: DataFrame, every: int = SECOND) -> DataFrame:
    """(id, component): documents that share one of their rarest live elements."""
    rows = sets(chosen(docs, ids), head(every)).select("doc_id", "n", "print", F.explode("elements").alias("element"))
    counts = written(rows.groupBy("element").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "ngram-counts")
    met = rows.join(counts, "element").groupBy("doc_id", "n", "print").agg(F.array_sort(F.collect_list(F.struct("c", "element"))).alias("live"))
    rarest = F.slice("live", 1, F.greatest(F.lit(0), (F.size("live") - _column(every, "needed") + 1).cast("int")))
    index = written(met.select("doc_id", F.explode(rarest).alias("e")).select("doc_id", "e.element"), "ngram-index")
    least = written(index.groupBy("element").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("element", "least"), "ngram-least")
    return components(index.join(least, "element").select(F.col("doc_id").alias("a"), F.col("least").alias("b")))


class Trie:
    """Sets of ordered whole numbers as a tree; a path without branches is one edge."""

    def __init__(self, rows: list[np.ndarray], sizes: np.ndarray):
        """``rows``: the elements of each set that the other block has as well, ascending; ``sizes``: all its elements."""
        order = sorted(range(len(rows)), key=lambda i: rows[i].tolist())
        self.order, self.rows = order, [rows[i] for i in order]
        self.sizes = sizes[order]
        self.lengths = np.array([len(r) for r in self.rows], np.int64)
        self.shared = np.zeros(len(rows), np.int64)  # leading elements in common with the set before
        for k in range(1, len(rows)):
            x, y = self.rows[k - 1], self.rows[k]
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            self.shared[k] = differ[0] if len(differ) else m

    def join(self, others: list[np.ndarray], other_sizes: np.ndarray, elements: int) -> tuple[np.ndarray, np.ndarray]:
        """All linked (set, other) pairs; ``others`` are ascending like the rows, below ``elements``."""
        a, b = THRESHOLD
        count = len(others)
        member = np.zeros((elements, count), np.uint8)
        for q, row in enumerate(others):
            member[row, q] = 1
        # Elements of each other set from a given one on: a search in all of them, laid end to end.
        base = np.arange(count, dtype=np.int64) * (elements + 1)
        flat = np.concatenate([row + base[q] for q, row in enumerate(others)]) if count else np.zeros(0, np.int64)
        ends = np.cumsum([len(row) for row in others])
        found: list[tuple[int, np.ndarray]] = []
        stack = [(0, len(self.rows), 0, np.zeros(count, np.int64))] if self.rows and count else []
        while stack:
            low, high, above, reached = stack.pop()
            row = self.rows[low]
            depth = int(self.shared[low + 1 : high].min()) if high - low > 1 else len(row)
            if depth > above:
                reached = reached + member[row[above:depth]].sum(axis=0, dtype=np.int64)
            after = int(row[depth - 1]) + 1 if depth else 0
            left = np.minimum(int(self.lengths[low:high].max()) - depth, ends - np.searchsorted(flat, base + after))
            best = reached + left
            if not (b * best >= a * (int(self.sizes[low:high].min()) + other_sizes - best)).any():
                continue  # nothing below can reach its threshold
            k = low
            while k < high and self.lengths[k] == depth:  # sets that end here sort first
                partners = np.flatnonzero(b * reached >= a * (int(self.sizes[k]) + other_sizes - reached))
                found.append((self.order[k], partners))
                k += 1
            starts = [k, *(k + 1 + np.flatnonzero(self.shared[k + 1 : high] == depth)).tolist(), high] if k < high else []
            stack += [(x, y, depth, reached) for x, y in zip(starts, starts[1:])]
        rows = np.repeat([i for i, _ in found], [len(p) for _, p in found]).astype(np.int64)
        return rows, np.concatenate([p for _, p in found]) if found else rows


def linked(left: list[np.ndarray], left_sizes: np.ndarray, right: list[np.ndarray], right_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of the two lists of sorted sets that link."""
    common, counts = np.unique(np.concatenate([np.concatenate(left), np.concatenate(right)]), return_counts=True)
    if left is not right:
        keep = np.isin(common, np.concatenate(left)) & np.isin(common, np.concatenate(right))
        common, counts = common[keep], counts[keep]
    place = np.empty(len(common), np.int64)
    place[np.lexsort((common, -counts))] = np.arange(len(common))  # frequent elements first

    def coded(row: np.ndarray) -> np.ndarray:
        at = np.searchsorted(common, row)
        at[at == len(common)] = 0
        return np.sort(place[at[common[at] == row]]) if len(common) else at[:0]

    rows = [coded(r) for r in left]
    others = rows if left is right else [coded(r) for r in right]
    return Trie(rows, left_sizes).join(others, right_sizes, len(common))


def compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """One tile: the links of each document in it, and the smallest document that it reaches there."""
    ids, copies, n = (pdf[c].to_numpy() for c in ("doc_id", "copies", "n"))
    right = pdf["right"].to_numpy()
    rows = list(pdf["elements"])
    none = pd.DataFrame({"doc_id": ids[:0], "links": copies[:0], "root": ids[:0]})
    own = bool((pdf["left_block"].iloc[0] == pdf["right_block"].iloc[0]) and (pdf["left_class"].iloc[0] == pdf["right_class"].iloc[0]))
    a = np.arange(len(rows)) if own else np.flatnonzero(~right)
    b = a if own else np.flatnonzero(right)
    if not len(a) or not len(b) or (own and len(a) < 2):
        return none
    left = [rows[i] for i in a]
    i, j = linked(left, n[a], left if own else [rows[k] for k in b], n[b])
    i, j = a[i], b[j]
    differ = i != j
    i, j = i[differ], j[differ]
    links = np.bincount(i, copies[j], len(rows)).astype(np.int64)
    if not own:
        links += np.bincount(j, copies[i], len(rows)).astype(np.int64)
    at = np.flatnonzero(links)
    if not len(at):
        return none
    nodes, least = roots(ids[i], ids[j])
    return pd.DataFrame({"doc_id": ids[at], "links": links[at], "root": least[np.searchsorted(nodes, ids[at])]})


def tiles(nodes: DataFrame) -> DataFrame:
    """(doc_id, links, root) from all tiles of ``nodes`` (component, doc_id, copies, n, elements)."""
    dealt = nodes.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(THRESHOLD[1] / THRESHOLD[0])) + 1e-9).cast("int"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_ELEMENTS)).cast("int")
    sizes = written(dealt.select("component", "class", "n").groupBy("component", "class").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("docs")), "ngram-blocks")
    of = lambda step, name: sizes.select("component", (F.col("class") - step).alias("class"), F.col("blocks").alias(name))
    plan = written(sizes.join(of(1, "above"), ["component", "class"], "left").join(of(-1, "below"), ["component", "class"], "left"), "ngram-plan")
    # Where a component's only class holds one document there is nobody to meet.
    plan = plan.where("docs > 1 or above is not null or below is not null").drop("docs")
    met = dealt.join(plan, ["component", "class"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("class").alias("left_class"), F.least(F.col("block"), j).alias("left_block"), F.col("class").alias("right_class"), F.greatest(F.col("block"), j).alias("right_block"), (F.col("block") > j).alias("right")))
    up = F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda j: F.struct(F.col("class").alias("left_class"), F.col("block").alias("left_block"), (F.col("class") + 1).alias("right_class"), j.alias("right_block"), F.lit(False).alias("right")))
    down = F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda j: F.struct((F.col("class") - 1).alias("left_class"), j.alias("left_block"), F.col("class").alias("right_class"), F.col("block").alias("right_block"), F.lit(True).alias("right")))
    every = F.concat(own, *(F.when(F.col(c).isNotNull(), x).otherwise(F.slice(own, 1, 0)) for c, x in (("above", up), ("below", down))))
    keys = ["component", "left_class", "left_block", "right_class", "right_block"]
    spread = met.select("component", "doc_id", "copies", "n", "elements", F.explode(every).alias("t")).select("component", "t.*", "doc_id", "copies", "n", "elements")
    return spread.groupBy(*keys).applyInPandas(compare, "doc_id long, links long, root long")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id), a row for each row of ``docs``."""
    return _classes(docs).select("doc_id", "n_shingles", "n_links", "component_id")


def _classes(docs: DataFrame) -> DataFrame:
    """The same with text_print and print, a digest of the set (null where it is empty)."""
    base = written(sets(docs, None).drop("elements"), "ngram-sets")
    groups = written(base.where("print is not null and doc_id is not null").groupBy("print", "n").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "ngram-groups")
    first = written(survivors(sets(docs, head(FIRST)), groups.select("doc_id", "n", "print"), FIRST), "ngram-first")
    # All that follows concerns these documents only, so all texts meet ids once.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = written(chosen(texts, first), "ngram-texts")
    second = written(survivors(sets(texts, head(SECOND)), first, SECOND), "ngram-second")
    near = written(candidates(texts, second), "ngram-candidates")
    members = near.select(F.col("id").alias("doc_id"), "component").unionByName(near.select(F.col("component").alias("doc_id"), "component")).distinct()
    members = written(members.join(groups, "doc_id").select("component", "doc_id", "copies", "print"), "ngram-members")
    full = sets(chosen(texts, members), lambda s: s).select("doc_id", "n", "print", "elements")
    # Copies of a set under one id are one node.
    nodes = full.join(members, ["doc_id", "print"]).dropDuplicates(["doc_id", "print"])
    found = written(tiles(nodes.select("component", "doc_id", "copies", "n", "elements")), "ngram-links")
    joined = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("doc_id").agg(F.sum("links").alias("links"))
    known = groups.join(counts, "doc_id", "left").join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    known = written(known.select("print", "n", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "doc_id").alias("component")), "ngram-known")
    own = base.join(known, ["print", "n"], "left")
    sound = F.col("doc_id").isNotNull() & F.col("copies").isNotNull()
    return own.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(sound, F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(sound, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_print",
        "print",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: the smallest doc_id, and where rows repeat
    it with equal sets, one of them. Rows of one id stay or go together otherwise; rows
    with a null id or without words stay."""
    found = _classes(docs).where("doc_id is not null and print is not null")
    texts = found.groupBy("doc_id", "print", "text_print").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    same = Window.partitionBy("doc_id", "print")
    gone = (F.col("component_id") != F.col("doc_id")) | (F.col("text_print") != F.min("text_print").over(same))
    marks = texts.withColumn("gone", gone).where("gone or rows > 1").select(F.col("doc_id").alias("_id"), F.col("text_print").alias("_print"), "gone")
    marks = written(marks, "ngram-marks")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    # Null texts have no words, so they are in no mark.
    rows = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("print"))
    own = (F.col("id") == F.col("_id")) & (F.col("print") == F.col("_print"))
    # One shuffle of the documents, by id and text; copies of a row then lie side by side.
    marked = rows.join(marks.hint("merge"), own, "left")
    place = F.row_number().over(Window.partitionBy("id", "print").orderBy("id"))
    kept = marked.withColumn("place", place).where("gone is null or (not gone and place = 1)")
    return kept.select("row.*")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLE = {
    "op3_ngram_join": """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), grams AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 75 * (s.n + t.n - count(*))
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles,
    (SELECT count(*) FROM links l WHERE l.x = d.doc_id)::BIGINT AS n_links,
    (SELECT min(y) FROM reach r WHERE r.x = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
""",
}
