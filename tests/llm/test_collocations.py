"""Phrases against counting by dictionaries, and double arrays against plain sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from findrift.llm import collocations as C


def brute(rows, support=C.MIN_COUNT, top=C.TOP):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    out = {}
    for (lang, g), a in cand.items():
        longer = [b for (m, h), b in cand.items() if m == lang and len(h) > len(g) and g in (h[:2], h[1:])]
        if any(100 * b >= C.KEPT_SHARE * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(g)):
            left, right = f[lang, g[:k]], f[lang, g[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(g).encode(), left, right))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def mined(spark, rows, **more):
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, code int, a string")
    return sorted(tuple(r) for r in C.mine(df.repartition(4), **more).collect())


def texts(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "the", "new", "york", "times", "of", "(a", "b)", "é", "日本", "x'y", "\x00"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!?", " ; "]
    out = [(rng.choice(["en", "de", None, ""]), "".join(w + rng.choice(marks) for w in rng.choices(words, k=rng.randrange(60)))) for _ in range(n)]
    return [*out, ("en", None), (None, ""), ("en", " .\n,"), ("de", "new york times " * 400), ("de", "one")]


@pytest.mark.parametrize("more", [{}, {"trie_phrases": 40, "lexicon_words": 9}])
@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed, more):
    assert mined(spark, texts(seed), **more) == brute(texts(seed))


def test_ties_and_top(spark):
    rows = [("en", "a b. c d. e f. é g")] * 12 + [("en", "a b c")] * 30
    want = brute(rows, top=3)
    assert mined(spark, rows, top=3) == want and len(want) == 3


def test_odd_rows_and_empty(spark, odd, none):
    rows = odd.selectExpr("case when doc_id > 8 then 'xx' end as lang", "*")
    want = brute([(r.lang, r.text) for r in rows.select("lang", "text").collect()])
    assert sorted(tuple(r) for r in C.mine(rows).collect()) == want
    assert C.mine(none.selectExpr("'en' as lang", "text")).count() == 0


def test_a_trie_reads_its_own_windows(spark, monkeypatch):
    """However many tries there are, their passes together read each pair of frequent words once."""
    context, read = spark.sparkContext, []
    real = C._starts

    def counted(c, shards):
        at = real(c, shards)
        read.add(len(at) if at is not None else int((c[:-3] >= 0).sum()))
        return at

    rows = texts(3)
    pairs = 0
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            pairs += max(0, len([x for x in re.split(r"[ \t]+", piece) if x]) - 1)
    monkeypatch.setattr(C, "_starts", counted)
    for few in (40, 10):
        read = context.accumulator(0)
        assert mined(spark, rows, trie_phrases=few) == brute(rows)
        assert 0 < read.value <= 2 * pairs  # one pass for triples, one for counts


def test_scores_past_64_bits(spark):
    a, left, right = 9_000_000_000_001, 9_500_000_000_003, 9_999_999_999_999
    df = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    assert df.select(C.score("a", "l", "r")).first()[0] == 10**6 * a * a // (left * right)


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_double_array(digits):
    rng = np.random.default_rng(digits)
    top = 1 << (8 * digits)
    draw = np.minimum((rng.pareto(0.6, (4000, 3)) * 3).astype(np.int64), top - 1)
    draw[::3, 2] = -1
    phrases = np.unique(draw, axis=0)
    base, check, state = C.build_trie(phrases, digits)
    assert len(set(state.tolist())) == len(phrases)
    text = np.concatenate([phrases[rng.permutation(len(phrases))[:500]].ravel(), rng.integers(-1, min(top, 9), 5000), [-1] * 3]).astype(np.int32)
    got = Counter()
    for words, (_, s) in enumerate(C.advance(text, base, check, digits, 3), 1):
        if words > 1:
            got.update(s.tolist())
    seq = text.tolist()
    want = Counter()
    for i in range(len(seq) - 3):
        for k in (2, 3):
            if min(seq[i : i + k]) >= 0:
                want[(*seq[i : i + k], -1)[:3]] += 1
    for p, s in zip(phrases.tolist(), state.tolist(), strict=True):
        assert got[s] == want[tuple(p)]
