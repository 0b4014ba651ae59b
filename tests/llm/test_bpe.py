import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from findrift.llm import bpe
from odd_rows import ODD

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def known(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids(known, text):
    return np.array(known.encode_ordinary(text or ""), "<u4").tobytes()


def test_equals_the_library_on_random_texts(codec, known):
    rng = random.Random(5)
    parts = [" ", "\n", "\t", "  ", "a", "b", "'s", "'ll", "the", "é", "ß", "12", "!", "\r", " ", "日本", "🙂", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 4000, "\n" * 999 + "x", "é" * 3001]
    got = codec.encode(texts)
    assert got == [ids(known, t) for t in texts]
    assert [codec.decode(x).decode() for x in got] == texts


def test_small_tables_give_the_same_ids(codec, known):
    small = bpe.PieceEncoder(P.PATTERN, lambda t: codec.merge([x.encode() for x in t]), 4, 4)
    texts = [f"some words {i} and more  words" for i in range(50)]
    for k in range(0, 50, 5):
        assert small(texts[k : k + 5]) == [ids(known, t) for t in texts[k : k + 5]]


def test_a_lower_rank_made_by_a_merge_comes_first():
    ranks = {bytes([i]): i + 10 for i in range(256)}
    ranks |= {b"ab": 400, b"abc": 3, b"cd": 401, b"bc": 402}
    c = bpe.Codec(ranks, ".+")
    assert np.frombuffer(c.merge([b"abcd" * 2])[0], "<u4").tolist() == [3, ord("d") + 10] * 2


def test_the_queue_orders_by_rank_then_place():
    q = bpe.RankQueue(50_000)
    for r, p in [(49_999, 1), (64, 9), (64, 2), (0, 5), (4096, 7)]:
        q.push(r, [p])
    out = []
    while (x := q.pop()) is not None:
        out.append(x)
    assert out == [(0, [5]), (64, [2, 9]), (4096, [7]), (49_999, [1])]


def test_odd_rows(odd, none, known):
    got = bpe.digests(odd, PATH, P.PATTERN).collect()
    want = []
    for i, t in ODD:
        x = ids(known, t)
        want.append((i, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    full = bpe.encode(odd, PATH, P.PATTERN).collect()
    assert sorted((r["decoded"].decode() for r in full)) == sorted(t or "" for _, t in ODD)
    assert bpe.digests(none, PATH, P.PATTERN).count() == 0
