"""The classifier against plain loops: counts, selection, ratios, weights and scores."""

import math
import random
import re

import numpy as np

from sessionlore.llm import toxicity

BAD, GOOD = ("vile", "scum", "ugh"), ("tea", "sun", "calm")


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(90):
        toxic = int(i % 3 == 0)
        words = rng.choices(["some", "plain", "words", "here", "é", "Two  Gaps\n"], k=rng.randint(2, 9))
        words += rng.choices(BAD if toxic else GOOD, k=rng.randint(1, 3)) * (rng.random() < 0.9)
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return rows


def grams(text):
    """Hashes of a text's n-grams, one by one with plain whole numbers."""
    text = " " + re.sub(r"\s+", " ", text.lower()).strip() + " "
    mask, (first, second), out = (1 << 64) - 1, map(int, toxicity.MIX), set()
    first, second = map(int, toxicity.MIX)
    for n in toxicity.SIZES:
        for at in range(len(text) - n + 1):
            held = 0
            for c in text[at : at + n]:
                held = (held * first + ord(c) + 1) & mask
            out.add((((held ^ n) * second) & mask) >> (64 - toxicity.BITS))
    return out


def brute_force(rows, most, least=toxicity.LEAST_DOCS, l2=1e-4):
    """Selected hashes and a scorer, fitted by Newton's method to the end."""
    sets, labels = [grams(t) for _, t, _ in rows], np.array([y for *_, y in rows], float)
    bad, good = labels.sum(), (1 - labels).sum()
    told = []
    for g in set().union(*sets):
        toxic, clean = (sum(g in s for s, y in zip(sets, labels) if y == k) for k in (1, 0))
        seen = toxic + clean
        if seen >= least:
            expected = seen * bad / (bad + good)
            told.append(((toxic - expected) ** 2 / expected + (toxic - expected) ** 2 / (seen - expected), g, toxic, clean))
    told.sort(key=lambda r: (-round(r[0], 9), r[1]))
    kept = told[:most]
    scale = np.array([math.log((t + 1) / (bad + 2)) - math.log((c + 1) / (good + 2)) for _, _, t, c in kept])
    x = np.array([[float(g in s) for _, g, *_ in kept] for s in sets])
    norm = 1 / np.sqrt(np.maximum(1, x.sum(axis=0)))
    design = np.hstack([x * scale * norm, np.ones((len(x), 1))])
    ridge = np.diag([l2] * len(kept) + [0.0])
    w = np.zeros(len(kept) + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - labels) / len(x) + ridge @ w
        hessian = (design * (p * (1 - p))[:, None]).T @ design / len(x) + ridge + 1e-12 * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    names = [g for _, g, *_ in kept]

    def score(text):
        own = grams(text)
        z = w[-1] + sum(w[i] * scale[i] * norm[i] for i, g in enumerate(names) if g in own)
        return 1 / (1 + math.exp(-z))

    return set(names), score


def test_model_against_plain_loops(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    names, score = brute_force(rows, 300)
    assert set(model.kept.tolist()) == names
    others = [(1000 + i, t) for i, t in enumerate(["", "vile scum", "tea in the sun", "ugh " * 50, "nothing known 漢字"])]
    every = spark.createDataFrame([*((i, t) for i, t, _ in rows), *others, (7, None)], "doc_id long, text string")
    texts = dict([*((i, t) for i, t, _ in rows), *others])
    got = [(r.doc_id, r.score) for r in toxicity.score(every, model).collect()]
    assert len(got) == len(texts) + 1  # a repeated id keeps its rows
    seen = set()
    for key, value in got:
        want = score(texts[key])
        if key == 7 and abs(value - want) > 0.05:
            want = score("")
        assert abs(value - want) < 0.02, (key, value, want)
        assert (value >= toxicity.THRESHOLD) == (want >= toxicity.THRESHOLD) or abs(want - toxicity.THRESHOLD) < 0.02
        seen.add(key)
    assert toxicity.score(every.limit(0), model).count() == 0 and toxicity.train(docs.limit(0), labels).kept.size == 0


def test_counts_against_plain_loops(spark):
    rows = corpus()[:20]
    sample = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int")
    got = {r.bucket: (r.toxic, r.clean) for r in toxicity.count_features(sample).collect()}
    want = {}
    for _, t, y in rows:
        for g in grams(t):
            a, b = want.get(g, (0, 0))
            want[g] = (a + y, b + 1 - y)
    assert got == want


def test_validation_uses_given_labels_only(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, "vile")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    loss, caught, lost = toxicity.validate(docs, labels, 1.0)
    assert loss < 0.5 and caught > 0.6 and lost < 0.3
