import hashlib
import random
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sessionlore.llm import alignment
from sessionlore.llm.tokens import vocabulary_path

from . import cases

A_PATH, B_PATH = vocabulary_path(alignment.A_FILE), vocabulary_path(alignment.B_FILE)


def brute_force(rows):
    """All token pairs of every whole text, by their byte ranges."""
    a, b = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {chr(x): x for x in printable}
    stands |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def a_bytes(i):
        return bytes(stands[c] for c in a.id_to_token(i))

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def ranges(ids, read):
        at, out = 0, []
        for i in ids:
            out.append((at, at := at + len(read(i)), i))
        return out

    found, counts = [], Counter()
    for key, text in rows:
        whole = (" " + text).encode() if text else b""
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or b"".join(map(a_bytes, ids[0])) != whole or b"".join(map(b_bytes, ids[1])) != whole:
            found.append((key, 0, 0, 0, [], ""))
            continue
        left, right = ranges(ids[0], a_bytes), ranges(ids[1], b_bytes)
        cuts = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
        pairs, groups, x, y = [], [], 0, 0
        for cut in cuts:
            p = next(i for i in range(x, len(left)) if left[i][1] == cut) + 1
            q = next(i for i in range(y, len(right)) if right[i][1] == cut) + 1
            groups.append(",".join(str(i) for _, _, i in left[x:p]) + "|" + ",".join(str(i) for _, _, i in right[y:q]))
            pairs += [(i, j) for s, e, i in left[x:p] for t, f, j in right[y:q] if s < f and t < e]
            x, y = p, q
        counts.update(pairs)
        found.append((key, len(left), len(right), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    return [(k, n_a, n_b, g, len(p), sum(counts[x] == most[x[1]] for x in p), sum(counts[x] for x in p), s) for k, n_a, n_b, g, p, s in found]


def texts():
    rng = random.Random(4)
    words = ["the", "anblewh", "<s>", "<|endoftext|>", "<0x41>", "don't", "漢字", "é", "😀", "\n\n", "\t", "", "", "x\x00y", "ﬁ", "\xa0", "\x1c", "123", "--", "▁", "　", "á"]
    out = ["", " ", "  ", " a", "a ", "a  b", "\n", "a\n b", "a \n b ", "▁", "x▁ y", "a" * 3000, "​", "  \n  a\n\n   b"]
    return out + [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(250)]


def test_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_ROWS", 40)
    docs = cases.documents(spark).where("doc_id is null or doc_id <> 9")
    docs = docs.unionByName(spark.createDataFrame(list(enumerate(texts(), 100)), "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.op12_alignment(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(brute_force(rows), key=str)
    assert sum(r[1] == 0 for r in got) > 4


def test_long_text_and_empty_table(spark):
    docs = cases.documents(spark).where("doc_id = 9")
    (named,) = alignment.token_groups(docs).collect()
    (row,) = alignment.aligned(docs).collect()
    assert (row.n_groups, row.groups_sha256) == (named.groups.count(";") + 1, hashlib.sha256(named.groups.encode()).hexdigest())
    assert alignment.aligned(cases.empty(spark)).count() == 0


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 30)
    small, large = alignment.Aligner(A_PATH, B_PATH), alignment.Aligner(A_PATH, B_PATH)
    for text in texts():
        one, other = small.read([text])[0], large.read([text])[0]
        assert small.digest(one) == large.digest(other)


def test_links():
    assert alignment.links([0, 1], [0, 1, 2], [3, 2], [1, 3, 1]) == [(0, 0), (0, 1), (1, 1), (1, 2)]


def test_unsupported_file():
    with pytest.raises(ValueError, match="space"):
        alignment.Aligner(vocabulary_path("word_bpe_49k.json"), B_PATH)
