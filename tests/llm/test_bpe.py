import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sessionlore.llm import bpe
from sessionlore.llm.tokens import vocabulary_path

from . import cases

PATH = vocabulary_path(bpe.VOCABULARY)


def plain_merges(symbols, ranks, wholes):
    """Merge the best pair, again and again, by looking at all pairs."""
    while found := [(ranks[p], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (p := a << bpe.SHIFT | b) in ranks]:
        rank, i = min(found)
        symbols = [*symbols[:i], wholes[rank], *symbols[i + 2 :]]
    return symbols


def test_merges_against_plain_loop():
    rng = random.Random(1)
    for _ in range(500):
        size = rng.randint(0, 14)
        pairs = list({(rng.randrange(3 + i), rng.randrange(3 + i)): None for i in range(size)})
        ranks = {a << bpe.SHIFT | b: rank for rank, (a, b) in enumerate(pairs)}
        wholes = [3 + rank for rank in range(len(pairs))]
        symbols = [rng.randrange(3) for _ in range(rng.randrange(25))]
        assert bpe.merged(list(symbols), ranks, wholes) == plain_merges(symbols, ranks, wholes)


def texts():
    rng = random.Random(2)
    alphabet = "abcdefgHIJK LMNÉéüßİıŒ''   \n\t.,!?0123456789²½ªµ×÷—漢字😀ΣςÅé\x1c \x85　ﬁ"
    out = ["", " \n", "it's we'll I'D 'S", "<|endoftext|>a<|startoftext|> <|endoftext|", "A" * 5000, "ab" * 3000, "ΑΣ ΟΔΟΣ", "é Å", "1234 ½3"]
    return out + ["".join(rng.choices(alphabet, k=rng.randint(1, 90))) for _ in range(1500)]


def test_equals_tokenizer():
    own, other = bpe.Bpe(PATH, remembered=500), Tokenizer.from_file(PATH)
    for text in texts():
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        want = other.encode(text, add_special_tokens=False).ids
        assert ids == want
        assert own.decode([own.encode(text)]).to_pylist() == [other.decode(want, skip_special_tokens=False)]
    assert own.decode([own.encode("it's"), b""]).to_pylist() == ["it</w> 's</w>", ""]


def test_unsupported_file():
    with pytest.raises(ValueError, match="unsupported"):
        bpe.Bpe(vocabulary_path())


def test_query(spark, tmp_path):
    docs = cases.documents(spark)
    special = spark.createDataFrame([(70 + i, t) for i, t in enumerate(texts()[:200])], "doc_id long, text string")
    docs.unionByName(special, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    other = Tokenizer.from_file(PATH)
    want = []
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        ids = other.encode(r.text or "", add_special_tokens=False).ids
        sums = (np.array(ids, "<u4").tobytes(), other.decode(ids, skip_special_tokens=False).encode())
        want.append((r.doc_id, len(ids), *(hashlib.sha256(x).hexdigest() for x in sums)))
    got = [tuple(r) for r in bpe.op11_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.encoded(cases.empty(spark)).count() == 0
