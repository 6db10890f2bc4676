import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlore.llm import graph, ngram_join, substrings, vectors

from . import cases


def grams(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def reach(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_roots(pairs):
    nodes, least = graph.roots(np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64))
    shift = [(a + 50, b + 50) for a, b in pairs]
    label = reach(101, shift)
    assert least.tolist() == [label[x + 50] - 50 for x in nodes.tolist()]


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)] + [(7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = reach(400, pairs)
    assert got == {i: label[i] for i in range(400) if label[i] != i}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_trie_finds_all_pairs(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(rng.integers(1, 8)):
        base = rng.choice(80, rng.integers(1, 40), replace=False)
        for _ in range(rng.integers(1, 4)):
            k = rng.integers(0, 1 + len(base) // 3)
            rows.append(np.unique(np.concatenate([base[k:], rng.integers(80, 120, k)])))
    half = rows[: max(1, len(rows) // 2)]
    for left, right in ((rows, rows), (rows, half)):
        i, j = ngram_join.linked(left, np.array([len(r) for r in left]), right, np.array([len(r) for r in right]))
        want = {(a, b) for a, x in enumerate(left) for b, y in enumerate(right) if 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))}
        assert set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("text", ["", "  ", "a b", "A a A a A a a a", "é É x\x1fy z\x0bq r s t", "x" * 5000 + " " + "y" * 5001, cases.LONG])
def test_shingles(text):
    assert len(ngram_join.shingles(text)) == len(grams(text))


def brute_classes(rows):
    sets = [grams(t) if k is not None else set() for k, t in rows]
    link = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= 75 * len(x | y)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if link(sets[i], sets[j])]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    place = {i: p for p, i in enumerate(order)}
    label = reach(len(rows), [(place[i], place[j]) for i, j in pairs])
    return sorted(((rows[i][0], len(grams(rows[i][1])), sum(i in p for p in pairs), rows[order[label[place[i]]]][0]) for i in range(len(rows))), key=str)


def test_join_on_cases(spark):
    docs = cases.documents(spark)
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted(((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in ngram_join.classes(docs).collect()), key=str)
    assert got == want
    kept = ngram_join.deduplicated(docs)
    assert cases.same_columns(kept, docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "9", "10", "11", "12", "13", "None"])
    again = spark.createDataFrame([(1, cases.BASE), (1, cases.BASE + " "), (1, "x y"), (2, cases.NEAR), (2, "q"), (2, "q"), (3, None), (3, None)], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text or "") for r in ngram_join.deduplicated(again).collect())
    assert [k for k, _ in kept] == [1, 1, 3, 3] and "x y" in {t for _, t in kept}  # rows of one id stay or go together
    assert ngram_join.classes(cases.empty(spark)).count() == 0


def test_join_with_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_ELEMENTS", 400)
    rng = np.random.default_rng(6)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(rng.integers(8, 90))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(0, len(w))] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join([*w, *(f"t{rng.integers(0, 10**6)}" for _ in range(rng.integers(0, 12)))])))
    line = " a line that very many of these documents have in common with others"
    rows += [(len(rows) + i, f"only {i} " + " ".join(f"u{i}x{k}" for k in range(40)) + line) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    got = sorted(((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in ngram_join.classes(docs).collect()), key=str)
    assert got == want
    assert sorted(r.doc_id for r in ngram_join.deduplicated(docs).collect()) == sorted(i for i, _, _, root in want if i == root)


def test_documents_meet_ids_by_one_plan(spark):
    """However few ids there are, they are not broadcast."""
    ids, texts = spark.range(3).withColumnRenamed("id", "doc_id"), spark.range(5).selectExpr("id AS doc_id", "'t' AS text")
    plan = ngram_join.chosen(texts, ids)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(240):
        x = base[i % 30] + rng.normal(size=16) * rng.choice([0, 0.02, 0.08, 0.2])
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(i % 2)))
    bad = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0, None] * 8, 0), (1004, rows[0][1], None), (1005, [], 0), (1006, [1.0] * 3, 0), (1007, rows[0][1], 0)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<float>, label int, v string, copies int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame, tile=50).collect()}
    alive = [r for r in rows] + [bad[7]]
    x = np.array([r[1] for r in alive])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.array([r[2] for r in alive])[:, None] == np.array([r[2] for r in alive]))
    np.fill_diagonal(near, False)
    label = reach(len(alive), list(zip(*np.nonzero(near))))
    for i, r in enumerate(alive):
        root = alive[label[i]][0]
        assert got[r[0]] == (int(near[i].sum()), root, root == r[0])
    assert all(got[r[0]] == (0, r[0], True) for r in bad[:7])
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_extreme_norms_and_ties(spark):
    rng = np.random.default_rng(17)
    rows = []
    for scale in (1e200, 1e-200, 1e300, 5e-310, 1.0):
        base = rng.normal(size=8)
        rows += [((base + rng.normal(size=8) * 0.01) * scale).tolist() for _ in range(4)]
    far = len(rows)
    # 49^2 + 9^2 + 3^2 + 3^2 = 50^2, so two cosines are 49/50 to the last bit.
    rows += [[1.0, *[0.0] * 7], [49.0, 9.0, 3.0, 3.0, *[0.0] * 4], [49.0, -9.0, 3.0, 3.0, *[0.0] * 4]]
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(frame, tile=7).collect()}
    assert all(got[i] == (3, i - i % 4) for i in range(far))
    assert [got[far + i] for i in range(3)] == [(2, far), (1, far), (1, far)]


def test_quantisation_bound():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(200, 1500)), rng.normal(size=(100, 1500))
    cx, sx, ex, hx = vectors.quantise(x)
    cy, sy, ey, _ = vectors.quantise(y)
    exact = cx.astype(np.int64) @ cy.astype(np.int64).T
    assert (vectors.code_products(cx, cy) == exact).all()
    cosine = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    assert (np.abs(cosine - exact * sx[:, None] * sy) <= hx[:, None] * ey + ex[:, None] + 1e-12).all()


def test_chunks_follow_content():
    rng = np.random.default_rng(9)
    text = " ".join("".join(rng.choice(list("abcdefghiéß"), rng.integers(2, 9))) for _ in range(800))
    digests, ends = substrings.chunks(text)
    assert ends[-1] == len(text) and (np.diff(ends) > 0).all()
    assert max(len(text[a:b].encode()) for a, b in zip([0, *ends], ends)) <= substrings.MOST
    moved, _ = substrings.chunks("an insertion at the front, " + text)
    assert len(set(digests.tolist()) - set(moved.tolist())) <= 3
    assert len(substrings.chunks("a" * 1000)[0]) == 7 and len(substrings.chunks("漢" * 400)[0]) > 1


def test_repeated_passages(spark):
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    passage = " ".join(word() for _ in range(60))
    line = " ".join(word() for _ in range(9))
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{filler(50)} {passage} {filler(40)}" if i < 5 else f"{filler(60)}\n{line}\n{filler(60)}") for i in range(30)]
    rows += [(100, None), (101, ""), (None, passage), (102, passage), (102, passage)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, row int")
    got = substrings.repeats(docs).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4, 102}
    texts = dict(rows[:30])
    for r in got:
        if r.doc_id < 30:
            assert texts[r.doc_id][r.start : r.end] in passage and r.first_doc == 0 and r.kept == (r.doc_id == 0)
    left = {r.doc_id: r.text for r in substrings.remove(docs).collect()}
    assert left[0] == texts[0] and left[7] == texts[7] and len(left[3]) < len(texts[3]) - 200 and left[101] == ""
    assert cases.same_columns(substrings.remove(docs), docs) and substrings.repeats(docs.limit(0)).count() == 0


def test_passages_on_cases(spark):
    docs = cases.documents(spark)
    got = substrings.repeats(docs).collect()
    assert got and all(r.doc_id is not None for r in got) and {r.doc_id for r in got} == {1, 2, 3}
    assert cases.same_columns(substrings.remove(docs), docs) and substrings.remove(docs).count() == docs.count()
    left = {r.doc_id: r.text for r in substrings.remove(docs).collect()}
    assert left[4] is None and left[5] == "" and left[9] == cases.LONG and left[1] == cases.BASE


def test_repeated_ids_and_long_vectors(spark):
    rng = np.random.default_rng(23)
    x = rng.normal(size=(3, 5000))
    near = (x[0] + rng.normal(size=5000) * 0.01).tolist()
    rows = [(1, x[0].tolist(), 0), (1, x[0].tolist(), 0), (2, near, 0), (3, x[1].tolist(), 0), (3, x[2].tolist(), 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.component_id, r.kept) for r in vectors.near_duplicates(frame).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]
