import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from sessionlore.llm import repair

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
COLUMNS = "conv_id long, turn long, role string, text string, conv int, id string, edits string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        key = (conv, turn is not None, turn or 0, role, text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(*key, copy, turn, role, text) for copy in range(1 + (kind == 3))]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:6]))


def cheapest(marks):
    """(cost, audit) by the least of all that may follow each place and role before it."""

    @lru_cache(None)
    def best(i, done, inserted):
        found = []
        if i == len(marks) and re.fullmatch("(s?(ua)+)?", {"": "", "s": "s", "u": "u", "a": "ua"}[done]):
            found.append((0, ""))
        wanted = "a" if done == "u" else "u"
        if inserted < 3:
            cost, rest = best(i, wanted, inserted + 1)
            found.append((cost + 3, "I" + rest))
        if i < len(marks):
            initial, fault = marks[i]
            cost, rest = best(i + 1, done, 0)
            found.append((cost + 4, "D" + rest))
            if fault in ("", "truncated"):
                extra = 3 * (fault == "truncated")
                cost, rest = best(i + 1, wanted, 0)
                found.append((cost + 3 + extra, "R" + rest))
                if initial == wanted or (initial == "s" and done == "") or initial == "":
                    cost, rest = best(i + 1, initial or done, 0)
                    found.append((cost + extra, "K" + rest))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def brute_force(rows):
    turns = damage(rows)
    for conv in {r[0] for r in rows}:
        own = [(t, role, text) for c, *_, t, role, text in turns if c == conv]
        marks, seen = [], set()
        for _, role, text in own:
            bare = text.strip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marks.append((role[:1], fault))
        cost, audit = cheapest(tuple(marks))
        lines, done, left = [], "", list(own)
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else left.pop(0)
            if edit == "D":
                continue
            role = role if edit == "K" else "assistant" if done == "u" else "user"
            done = role[:1] or done
            lines.append(f"{role}:{text}")
        assert not left and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines if x[0] != ":"))
        known = {t for t, _, _ in own if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        faults = [sum(f == kind for _, f in marks) for kind in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        yield conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(rng, n):
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "superb"])
            text = rng.choice(["Yes.", "Go on", "Why?  \n", " \t\n", "", None, "a.b", " ", f"Say {rng.randint(0, 99)}!", "Yes."])
            rows.append((conv, rng.choice([turn, turn, turn + 2, None, 3]), role, text))
    return rows + rows[:5]


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_against_brute_force(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = conversations(random.Random(bits), 300)
    spark.createDataFrame([(*r, 1, "i", "e") for r in rows], COLUMNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in repair.op13_repair(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(brute_force(rows), key=str)


def test_sql_counterpart(spark, tmp_path):
    rows = conversations(random.Random(77), 200)
    spark.createDataFrame([(*r, 1, "i", "e") for r in rows], COLUMNS).write.parquet(f"{tmp_path}/conversations.parquet")
    for source in (str(tmp_path), "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{source}/conversations.parquet{'/part-*' if source == str(tmp_path) else ''}')")
        result = con.execute(repair.ORACLE["op13_repair"])
        assert [d[0] for d in result.description] == (frame := repair.op13_repair(spark, source)).columns
        assert sorted(result.fetchall(), key=str) == sorted(map(tuple, frame.collect()), key=str)


def test_lines_long_text_and_empty_table(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "user", "Yes."), (2, 0, None, None)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = [tuple(r) for r in repair.repaired(made, lines=True).collect()]
    assert sorted(lines) == [(1, 0, "user", long), (1, 1, "assistant", "Yes.")]
    costs = {r.conv_id: (r.cost, r.audit) for r in repair.repaired(made).collect()}
    assert costs == {1: (6, "KR"), 2: (4, "D")}
    empty = spark.createDataFrame([], COLUMNS)
    assert repair.repaired(empty).count() == 0 and repair.repaired(empty, lines=True).count() == 0


def test_layers_are_shared():
    seen = []
    plain = repair.step
    repair.step = lambda layer, mark: seen.append(mark) or plain(layer, mark)
    try:
        names = ["AAB", "AABC", "AAD", "B"]
        list(repair.trie_answers((True, n) for n in names))
    finally:
        repair.step = plain
    assert len(seen) == 6  # as many as the trie has nodes below its root


def test_whole_conversation_dropped(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(conv, 0, "user", "Yes.")], "conv_id long, turn long, role string, text string")
    assert tuple(repair.repaired(rows, repair.damaged).first()) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
