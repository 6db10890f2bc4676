"""Keepers of repeated passages."""

import numpy as np

from sessionlore.llm import substrings


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(n))


def brute(rows, passage):
    """Characters of each document in windows that a smaller document holds, by comparing all chunk runs."""
    lost = {}
    for doc, text in rows:
        digests, ends = substrings.chunks(text)
        starts = [0, *ends[:-1].tolist()]
        gone = np.zeros(len(text), bool)
        for other, held in rows:
            if other >= doc:
                continue
            theirs = substrings.chunks(held)[0]
            for i in range(len(digests)):
                for k in np.flatnonzero(theirs == digests[i]):
                    n = 0
                    while i + n < len(digests) and k + n < len(theirs) and digests[i + n] == theirs[k + n]:
                        n += 1
                    if ends[i + n - 1] - starts[i] >= passage:
                        gone[starts[i] : ends[i + n - 1]] = True
        lost[doc] = gone
    return lost


def test_keepers_by_passage(spark):
    rng = np.random.default_rng(11)
    first, second = words(rng, 60), words(rng, 60)
    by_chance = second[60:110]
    rows = [(1, f"{words(rng, 30)} {by_chance} {words(rng, 30)}"), (5, f"{words(rng, 30)} {first} {words(rng, 30)}"), (6, f"{words(rng, 30)} {second} {words(rng, 30)}"), (7, f"{words(rng, 30)} {first} {second} {words(rng, 30)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.repeats(docs).collect()
    assert {(r.doc_id, r.first_doc, r.kept) for r in got} == {(5, 5, True), (6, 6, True), (7, 5, False), (7, 6, False)}
    assert all(r.end - r.start >= substrings.PASSAGE for r in got)
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.end] in texts[r.first_doc] for r in got)
    left = {r.doc_id: r.text for r in substrings.remove(docs).collect()}
    assert all(left[i] == texts[i] for i in (1, 5, 6)) and len(left[7]) < len(texts[7]) - 450


def test_parts_against_brute_force(spark):
    rng = np.random.default_rng(12)
    parts = [words(rng, int(rng.integers(3, 40))) for _ in range(12)]
    rows = [(i, " ".join([words(rng, 5), *(parts[k] for k in rng.integers(0, 12, 4))])) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, substrings.PASSAGE)
    got = {i: np.zeros(len(t), bool) for i, t in rows}
    for r in substrings.repeats(docs).where("not kept").collect():
        got[r.doc_id][r.start : r.end] = True
    assert sum(want[i].sum() for i in want) > 1000 and all((got[i] == want[i]).all() for i in want)
    left = {r.doc_id: r.text for r in substrings.remove(docs).collect()}
    assert all(left[i] == "".join(c for c, g in zip(t, want[i]) if not g) for i, t in rows)
