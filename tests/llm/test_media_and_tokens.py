import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sessionlore.llm import media, packing, token_files, tokens
from sessionlore.llm.tokens import Encoder, vocabulary_path

from . import cases


def test_png_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for payload in (bytes(64), b"abc" + bytes(61), rng.integers(0, 256, 64 * 33).astype(np.uint8).tobytes(), b"the same line " * 320):
        stored = media.encode_png(payload)
        assert media.decode_png(stored).tobytes() == payload
        for at in (0, 20, len(stored) // 2, len(stored) - 5):
            broken = bytearray(stored)
            broken[at] ^= 1
            with pytest.raises((media.MediaError, zlib.error)):
                media.decode_png(bytes(broken))
        with pytest.raises(media.MediaError):
            media.decode_png(stored[:-4])


def test_every_filter():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (12, 9)).astype(int)
    lines = np.zeros((12, 10), np.uint8)
    for y in range(12):
        kind = (0, 1, 2, 3, 4, 2, 2, 4, 3, 1, 2, 2)[y]
        lines[y, 0] = kind
        for x in range(9):
            a = image[y, x - 1] if x else 0
            b = image[y - 1, x] if y else 0
            c = image[y - 1, x - 1] if x and y else 0
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            lines[y, x + 1] = (image[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    assert (media.unfilter(lines) == image).all()
    only = lines.copy()
    only[:, 0] = [0, 2, 2, 1, 2, 0, 2, 2, 2, 1, 1, 2]
    slow = only.copy()
    slow = np.vstack([slow, np.full((1, 10), 3, np.uint8)])  # an average row forces the general path
    assert (media.unfilter(only) == media.unfilter(slow)[:12]).all()


def test_short_header():
    short = media.SIGNATURE + media.chunk(b"IHDR", b"123") + media.chunk(b"IEND", b"")
    with pytest.raises(media.MediaError, match="header"):
        media.decode_png(short)


def slow_hash(pixels):
    """Block means, cosine transform and signs by plain loops over whole numbers."""
    height, width = len(pixels), len(pixels[0])
    cells = [[0] * 32 for _ in range(32)]
    for v in range(32):
        top, bottom = v * height // 32, max(v * height // 32 + 1, (v + 1) * height // 32)
        for u in range(32):
            left, right = u * width // 32, max(u * width // 32 + 1, (u + 1) * width // 32)
            block = [int(pixels[y][x]) for y in range(top, bottom) for x in range(left, right)]
            cells[v][u] = sum(block) // len(block)
    wave = [[round(math.cos(math.pi * (2 * x + 1) * k / 64) * 16384) for x in range(32)] for k in range(8)]
    low = [sum(wave[i][y] * wave[j][x] * cells[y][x] for y in range(32) for x in range(32)) for i in range(8) for j in range(8)]
    low[0] = 0
    middle = sorted(low)[32]
    return int("".join(str(int(v > middle)) for v in low), 2).to_bytes(8, "big")


@pytest.mark.parametrize("rows", [1, 3, 31, 32, 33, 200])
def test_cosine_hash_against_loops(rows):
    pixels = np.random.default_rng(rows).integers(0, 256, (rows, 64)).astype(np.uint8)
    assert media.cosine_hash(pixels) == slow_hash(pixels)


def test_media_query(spark):
    docs = cases.documents(spark)
    got = {r.doc_id: r for r in media.media_features(media.to_media(docs)).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert bytes(got[r.doc_id].payload) == payload and got[r.doc_id].n_bytes == len(raw)
    assert got[1].cosine_hash == got[2].cosine_hash and got[1].media_sha256 == got[2].media_sha256
    assert media.media_features(media.to_media(cases.empty(spark))).count() == 0
    broken = spark.createDataFrame([(1, 3, b"nonsense"), (2, 3, None)], "doc_id long, n_bytes long, media binary")
    assert [r.media_sha256 for r in media.media_features(broken).collect()] == [None, None]


def test_encoder_equals_tokenizer():
    enc = Encoder(vocabulary_path())
    random.seed(3)
    alphabet = "abcXYZ éüß'  \n\t.,!?0123456789²½ªµ×÷½—漢😀\x1c \x85<|endoftext|>"
    texts = ["", "it's we'll  I'd", "a  b   c\n\n d ", "<|endoftext|> x", "\x1f \x0b", *("".join(random.choices(alphabet, k=random.randint(1, 80))) for _ in range(1500))]
    texts += ["".join(random.choices(["<|endoftext|>", "<|", "endoftext", "|>", " a", "b ", "\n"], k=random.randint(1, 20))) for _ in range(300)]
    want = [e.ids for e in Tokenizer.from_file(vocabulary_path()).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(texts)] == want and 50256 in want[3]
    assert [x.tolist() for x in enc.encode(texts)] == want  # from memory


def test_encoder_with_another_vocabulary():
    """Other splitting rules: nothing is split here, and all ids are the tokenizer's own."""
    path = vocabulary_path("word_bpe_49k.json")
    texts = ["it's  ONE word\n and\t1234 more", "", "é漢😀 <|endoftext|> x", "<|startoftext|>a"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(path).encode(texts)] == want


def test_elias_fano():
    rng = np.random.default_rng(4)
    for values in ([], [0], [0, 0, 7], np.cumsum(rng.integers(0, 5000, 3000)).tolist(), [10**12, 10**12 + 1], list(range(600))):
        read, at = token_files.EliasFano.read(token_files.EliasFano.of(values).to_bytes(), 0)
        assert [v for run in read.runs() for v in run.tolist()] == values and [read.select(i) for i in range(len(values))] == values
        with pytest.raises(IndexError):
            read.select(len(values))


def test_shards():
    ids = [np.arange(n, dtype="<u2") for n in (1, 5, 2)]
    data = token_files.pack_shard([None, -3, 9], [1, 5, 2], ids)
    shard = token_files.Shard(data)
    assert shard.doc_ids() == [None, -3, 9] and [shard.ids(i).tolist() for i in range(3)] == [x.tolist() for x in ids]
    with pytest.raises(ValueError, match="damaged"):
        token_files.Shard(data[:-5] + b"x" + data[-4:])


def test_token_files(spark, tmp_path):
    docs = cases.documents(spark)
    special = spark.createDataFrame([(70 + i, f"a <|endoftext|> b{i}<|endoftext|>") for i in range(3)], "doc_id long, text string")
    docs = docs.unionByName(special, allowMissingColumns=True)
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path, shard_ids=5_000, partitions=3)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, path).collect())
    plain = Tokenizer.from_file(vocabulary_path())
    start = 0
    for (key, first, n, crc), r in zip(got, sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)), strict=True):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (key, first, n, crc) == ((r.doc_id is not None, r.doc_id or 0), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    empty = f"file://{tmp_path}/empty"
    token_files.write_token_files(cases.empty(spark), empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def check_pack(rows, texts, window):
    plain = Tokenizer.from_file(vocabulary_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc, key=str) == sorted({k for k, _ in texts}, key=str)
    used = {}
    for s, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        used[s] = at
    for k, text in dict(texts).items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        copies = sum(1 for x, _ in texts if x == k)
        pieces = sorted(by_doc[k], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == copies * len(ids)
        for r in pieces:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    padding = sum(0 if u & (u - 1) == 0 else window - u for u in used.values())
    return padding / max(1, sum(used.values()))


def test_packing(spark):
    special = spark.createDataFrame([(70, "a <|endoftext|> b")], "doc_id long, text string")
    docs = cases.documents(spark).unionByName(special, allowMissingColumns=True)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for window in (2048, 64):
        assert check_pack(packing.pack(docs, window=window, slack=2).collect(), texts, window) < 0.04
    assert packing.pack(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("histogram", [{700: 1000}, {1: 5000}, {2047: 9, 1: 4}, {1500: 100, 548: 90, 300: 7}, {i: i % 7 for i in range(1, 2048)}, {}])
def test_plan_uses_each_piece_once(histogram):
    patterns, rest = packing.plan(histogram)
    left = dict(histogram)
    for own, n in patterns:
        assert 2048 - 8 <= sum(own) <= 2048
        for length in own:
            left[length] -= n
    assert all(left[k] == rest.get(k, 0) for k in left)


def test_op2_matches_brute_force(spark):
    frame = media.op2_media(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in frame.collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_header():
    assert struct.unpack(">II", media.encode_png(bytes(640))[16:24]) == (64, 10)


def test_words_are_looked_up_by_groups(monkeypatch):
    """Words not met before are learned once a group of texts; ids are the library's at every size of a group."""
    path = tokens.vocabulary_path()
    texts = ["a café's new words", "", "new words again\n\n  we'll see ", "\x01 control", "日本", "x<|endoftext|>y", "it's 12 élan !", "longer " * 50]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for group, most in ((1 << 20, 1), (1, 4), (60, 4)):
        monkeypatch.setattr(tokens, "GROUP", group)
        enc, calls = tokens.Encoder(path), []
        monkeypatch.setattr(enc, "_learn", lambda unmet, f=enc._learn: (calls.append(unmet), f(unmet)))
        assert [ids.tolist() for ids in enc.encode(texts)] == want and len(calls) <= most, group
        assert len(set().union(*calls)) == sum(map(len, calls))
        assert [ids.tolist() for ids in enc.encode(texts)] == want and len(calls) <= most


def test_words_of_joined_texts_begin_where_the_expression_divides_each():
    rng = random.Random(11)
    parts = ["'", " ", " ", "\n", "\t", "s", "t", "re", "v", "e", "m", "ll", "l", "d", "a", "S", "é", "12", "²", ".", ",", "'s", " 'd"]
    for _ in range(3000):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 5))]
        joined, starts = "".join(texts), np.cumsum([0] + [len(x) for x in texts[:-1]])
        begins = tokens.word_starts(np.frombuffer(joined.encode("utf-32-le"), np.uint32), starts).tolist()
        assert [joined[a:b] for a, b in zip(begins, [*begins[1:], len(joined)])] == [w for x in texts for w in tokens.WORDS.findall(x)]
