import random

import numpy as np
import pyarrow as pa

from findrift.llm import words as W
from odd_rows import words


def test_words_of_slices_and_nulls():
    texts = ["", None, " a  B\tc", "x", " ", "é\x0bé y", None, "Q q"]
    col = pa.array(["skip me", *texts, "and me"]).slice(1, len(texts))
    h, first = W.hashed(col)
    got = [h[first[k] : first[k + 1]].tolist() for k in range(len(texts))]
    names = {}
    for t, hs in zip(texts, got):
        assert len(words(t)) == len(hs)
        for w, x in zip(words(t), hs):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_hashes_differ_and_do_not_depend_on_place(monkeypatch):
    rng = random.Random(2)
    many = sorted({"".join(rng.choices("abcd\x01", k=rng.randint(1, 9))) for _ in range(60_000)})
    one = W.hashed(pa.array([" ".join(many)]))[0]
    assert len(set(one.tolist())) == len(many)
    monkeypatch.setattr(W, "SLAB", 8192)
    assert (W.hashed(pa.array([" ".join(many[k : k + 7]) for k in range(0, len(many), 7)]))[0] == one).all()


def test_shingles_are_distinct_per_text():
    g, first = W.shingles(pa.array(["a b c d e f", "a b c d e a b c d e", "", "a b", "A B", "a b c d e"]))
    n = np.diff(first).tolist()
    assert n == [2, 5, 0, 1, 1, 1]
    assert g[first[3]] == g[first[4]] and g[first[5]] in g[first[0] : first[1]]
