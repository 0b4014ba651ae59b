import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from findrift.llm import packing
from odd_rows import ODD

PATH = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(8))
def test_pack_places_every_token_once(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 65, rng.integers(0, 200))
    if seed == 0:
        n = np.full(100, 33)  # no two fit one sequence of 64
    found = packing.pack(n, 64)
    parts, seqs = defaultdict(list), defaultdict(list)
    for item, start, size, s, at in found:
        assert size > 0
        parts[item].append((start, size))
        seqs[s].append((at, size))
    for k, total in enumerate(n):
        at = 0
        for start, size in sorted(parts[k]):
            assert start == at
            at += size
        assert at == total
    ends = []
    for v in seqs.values():
        at = 0
        for o, size in sorted(v):
            assert o == at
            at += size
        ends.append(at)
    assert sum(e != 64 for e in ends) <= 1 and all(e <= 64 for e in ends)


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(8, 400, 3000))[::-1]
    cost = defaultdict(float)
    for _, _, size, s, _ in packing.pack(n, 2048):
        cost[s] += packing.cost(size)
    c = np.array(list(cost.values()))
    assert c.std() / c.mean() < 0.15


def check(rows, texts):
    """All pieces of all documents, by ids of the library itself."""
    tk = Tokenizer.from_file(PATH)
    tk.encode_special_tokens = True
    ids = [[*tk.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    want = defaultdict(int)
    for x in ids:
        want[zlib.crc32(np.array(x, "<u4").tobytes()), len(x)] += 1
    seqs = defaultdict(list)
    total = 0
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(map(len, ids))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    return ids


def test_odd_rows(odd, none):
    rows = packing.sequences(odd, PATH, P.PATTERN, block_tokens=20_000).collect()
    ids = check(rows, [t for _, t in ODD])
    by_id = defaultdict(list)
    for (i, _), x in zip(ODD, ids):
        by_id[i].append(x)
    for i, lists in by_id.items():
        if len(lists) == 1:
            at = 0
            for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
                part = lists[0][r["start"] : r["start"] + r["length"]]
                assert r["start"] == at and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
                assert r["doc_tokens"] == len(lists[0])
                at += r["length"]
            assert at == len(lists[0])
    assert packing.sequences(none, PATH, P.PATTERN).count() == 0
