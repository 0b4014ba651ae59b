import random

import numpy as np

from findrift.llm import toxicity
from odd_rows import ODD

GOOD = "the quick river runs over mild green hills and slow boats drift along in quiet rain".split()
BAD = ["grubling", "snorkest", "vexoraan", "vexoriel"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.25
        sent = [" ".join(rng.choices(GOOD, k=rng.randint(4, 12))) for _ in range(rng.randint(1, 30))]
        if toxic:
            k = rng.randrange(len(sent))
            sent[k] += " " + rng.choice(BAD) + rng.choice(["", ","])
        rows.append((seed * 100_000 + i, ". ".join(sent), int(toxic)))
    return rows


def test_held_out_documents_and_sentences(spark):
    rows = corpus(1500, 1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    fresh = corpus(400, 2)
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(fresh, "doc_id bigint, text string, toxic int"), model).collect()}
    right = sum(got[i]["predicted"] == y for i, _, y in fresh)
    assert right >= 0.99 * len(fresh)
    assert all(0 <= got[i]["score"] <= 1 for i, _, _ in fresh)
    for i, text, y in fresh:
        if y and got[i]["predicted"]:
            assert any(any(b[:4] in text[s["start"] : s["end"]] for b in BAD) for s in got[i]["spans"])


def test_gradient_finds_the_likelihood(spark):
    bags = [(1, [[0]], 3), (0, [[1]], 3), (1, [[0], [1]], 2), (0, [], 4), (0, [[1], [1]], 0)] * 20
    w, bias = toxicity.fit(bags, 2)
    p = lambda z: 1 / (1 + np.exp(-z))
    assert p(bias + w[0]) > 0.9 and p(bias + w[1]) < 0.05 and p(bias) < 0.05


def test_sample_bound_and_label_noise(spark):
    rows = corpus(400, 3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = df.select("doc_id", "toxic").unionAll(spark.createDataFrame([(None, 1), (300_001, 7), (300_002, None)], "doc_id bigint, toxic int"))
    a = toxicity.train(df.drop("toxic"), labels, sample=200)
    b = toxicity.train(df.drop("toxic").repartition(5), labels.repartition(3), sample=200)
    assert a.weights.keys() == b.weights.keys() and abs(a.bias - b.bias) < 1e-6


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(r["predicted"] == 0 for r in rows)
    assert all(r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    kept = toxicity.reject(odd, toxicity.Model({"=three": 9.0}, -4.0))
    assert kept.columns == odd.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(i) for i, _ in ODD if i != 5)
    assert toxicity.score(none, model).count() == 0
