import random
from collections import defaultdict

import pytest

from findrift.llm import jaccard as J
from odd_rows import ODD, words


def sets_of(text):
    w = words(text)
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def brute(rows):
    s = [sets_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    hold = defaultdict(list)
    for k, x in enumerate(s):
        for g in x:
            hold[g].append(k)
    pairs = {(a, b) for v in hold.values() for a in v for b in v if a < b} if len(rows) < 1500 else set()
    for a, b in pairs:
        if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
            up[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    return sorted(((i, len(s[k]), low[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    make = lambda n: rng.choices(vocabulary, k=n)
    passage = make(60)
    rows = []
    for _ in range(40):
        base = make(rng.randint(3, 120))
        for _ in range(rng.randint(1, 6)):  # near copies on both sides of the threshold
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    base = make(150)
    for _ in range(60):  # one large group of near copies
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append(" ".join(w))
    rows += [" ".join(passage + make(rng.randint(5, 40))) for _ in range(60)]  # a passage many share
    rows += ["same text for all of these rows here"] * 30
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.classes(df).collect()), key=str)
    assert got == brute(rows)


def test_exactly_at_the_threshold(spark):
    # 8 of 10 shingles shared: 100 * 8 = 80 * 10; one fewer is not enough
    a = "a b c d e f g h i j k l m"  # 9 shingles
    b = "a b c d e f g h i j k l x"  # 8 of them, and one more
    c = "a b c d e f g h i j k x y"
    rows = [(1, a), (2, b), (3, c)]
    got = {r["doc_id"]: r["component_id"] for r in J.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 2} or got == {i: v for i, _, v in brute(rows)}
    assert sorted((i, n, v) for i, n, v in brute(rows)) == sorted(
        (r["doc_id"], r["n_shingles"], r["component_id"])
        for r in J.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    )


@pytest.mark.parametrize("many", [200, 400])
def test_a_passage_too_short_to_link_makes_no_pairs(spark, monkeypatch, many):
    made, across = [], J.across
    monkeypatch.setattr(J, "across", lambda *a: made.append(across(*a)) or made[-1])
    passage = " ".join(f"p{i}" for i in range(104))
    rows = [(i, passage + " " + " ".join(f"d{i}x{k}" for k in range(20))) for i in range(many)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = [(r["doc_id"], r["component_id"]) for r in J.classes(df).collect()]
    assert sorted(got) == [(i, i) for i in range(many)]
    assert made[0].count() <= many  # all pairs are many * (many - 1) / 2 for each of five shingles


def test_lengths_at_the_ends_of_the_bands(spark):
    # each set is the start of one long text; neighbours and sets of four fifths of the length link
    whole = [f"w{i}" for i in range(160)]
    for step in (1, 7, 30):
        rows = [(i, " ".join(whole[:n])) for i, n in enumerate(range(12, 160, step))]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.classes(df).collect()), key=str)
        assert got == brute(rows)


def test_odd_rows(odd, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.classes(odd).collect()), key=str)
    assert got == [tuple(x) if x[1] else (x[0], 0, x[0]) for x in brute(ODD)]
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(7) == 1 and 8 not in ids and None in ids and {1, 2, 3} <= set(ids)
    assert J.classes(none).count() == 0 and J.one_of_each(none).count() == 0
