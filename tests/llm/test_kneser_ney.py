import math
import random
from collections import Counter, defaultdict

import pytest

from findrift.llm import kneser_ney as K
from odd_rows import ODD, words


def brute(train):
    uni, bi = Counter(), Counter()
    for t in train:
        w = [*words(t), "</s>"]
        uni.update(w)
        bi.update(zip(["<s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    ctx, seen, cont = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, b), c in bi.items():
        ctx[a] += c
        seen[a][min(c, 3) - 1] += 1
        cont[b] += 1
    d = (0.0, *K.discounts(*[sum(c == j for c in bi.values()) for j in (1, 2, 3, 4)]))
    e = (0.0, *K.discounts(*[sum(c == j for c in cont.values()) for j in (1, 2, 3, 4)]))
    many = len(bi)
    rest = sum(e[min(c, 3)] for c in cont.values()) / many if many else 1.0

    def p(a, b):
        low = (max(cont[b] - e[min(cont[b], 3)], 0) / many if many else 0) + rest / (v + 1)
        if not ctx[a]:
            return low
        c = bi[a, b]
        return max(c - d[min(c, 3)], 0) / ctx[a] + sum(x * y for x, y in zip(d[1:], seen[a])) / ctx[a] * low

    return p, uni, n, v


def compare(got, texts, train):
    p, uni, n, v = brute(train)
    assert len(got) == len(texts)
    want = []
    for i, t in texts:
        w = [*words(t), "</s>"]
        s = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w))
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        want.append((i, len(w), sum(uni[x] > 0 for x in w), base, s))
    rows = [(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got]
    for a, b in zip(sorted(rows, key=str), sorted(want, key=str)):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == pytest.approx(b[4])


def test_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(K, "FLUSH", 500)
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices("the The of a in on cat dog runs sits blue tree x y z".split(), [30, 9, 9, *[3] * 12], k=rng.randint(0, 30)))
    rows = [(i, text()) for i in range(400)] + [(900, "the " * 600)]  # a count beyond one byte
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = K.train(df.where("doc_id % 3 <> 0").repartition(5))
    compare(K.score(df, model).collect(), rows, [t for i, t in rows if i % 3])
    assert model.tokens == sum(len(words(t)) + 1 for i, t in rows if i % 3)


def test_probabilities_sum_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["a b a", "b c", "a", "", "c c c a"])]
    model = K.train(spark.createDataFrame(rows, "doc_id int, text string"))
    vocabulary = ["a", "b", "c"]
    ask = spark.createDataFrame([(w, f"{v} {w}") for v in ("a", "c") for w in [*vocabulary, "never"]], "doc_id string, text string")
    first = {r["doc_id"]: r["score"] for r in K.score(spark.createDataFrame([(v, v) for v in vocabulary], "doc_id string, text string"), model).collect()}
    assert len(first) == 3 and ask.count() == 8
    p, *_ = brute([t for _, t in rows])
    for v in ("<s>", "a", "b", "c"):
        assert sum(p(v, w) for w in [*vocabulary, "</s>", "?"]) == pytest.approx(1.0)


def test_odd_rows(odd, none):
    model = K.train(odd)
    compare(K.score(odd, model).collect(), ODD, [t for _, t in ODD])
    assert K.score(none, model).count() == 0
    empty = K.train(none)
    rows = K.score(odd, empty).collect()
    assert len(rows) == len(ODD) and all(r["n_known"] == 0 and r["base_score"] == 0 for r in rows)
