import random

import pytest
from pyspark.sql import functions as F

from findrift.functions import edits as E
from findrift.functions import text as T
from findrift.functions.stemmer import with_stems
from findrift.operators import fuzzy


def one(spark, col, **values):
    row = spark.createDataFrame([values]).select(col.alias("x")).first()
    return row.x


def test_words(spark):
    assert one(spark, T.words(F.col("t")), t="Don't stop: Été 2020!") == [
        "don", "t", "stop", "été", "2020",
    ]


def test_edge_grams(spark):
    assert one(spark, T.edge_grams(F.col("t")), t="a") == []
    assert one(spark, T.edge_grams(F.col("t")), t="glass") == ["gl", "gla", "glas", "glass"]
    assert one(spark, T.edge_grams(F.col("t")), t="x" * 40)[-1] == "x" * 15


def test_possessive(spark):
    got = one(spark, T.strip_possessive(F.col("t")), t="Anna's cat's tail; its Anna’s")
    assert got == "Anna cat tail; its Anna"


# pairs printed in the stemmer's paper
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre
plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi
sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit conformabli conform radicalli radic differentli differ vileli vile
analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
yes ye yet yet say sai at at oed o""".split()


def test_stems(spark):
    pairs = dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    pairs.pop("oed")
    df = spark.createDataFrame([(w,) for w in pairs], "term STRING")
    got = {r.term: r.stem for r in with_stems(df).collect()}
    assert got == pairs


def damerau(a, b):
    """Unrestricted distance with swaps, by dynamic programming."""
    last, big = {}, len(a) + len(b)
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            i1, j1, cost = last.get(b[j - 1], 0), db, 1
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            d[i, j] = min(
                d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1,
                d[i1 - 1, j1 - 1] + (i - i1 - 1) + 1 + (j - j1 - 1),
            )
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(4)
        p = rng.randrange(len(s)) if s else 0
        if k == 0:
            s.insert(p, rng.choice("abcé"))
        elif s and k == 1:
            del s[p]
        elif s and k == 2:
            s[p] = rng.choice("abcé")
        elif k == 3 and p + 1 < len(s):
            s[p], s[p + 1] = s[p + 1], s[p]
    return "".join(s)


def test_edits_against_dynamic_programming(spark):
    rng = random.Random(5)
    pairs = [("ca", "abc"), ("", ""), ("a", ""), ("ab", "ba"), ("xzy", "yx"), ("abcd", "badc")]
    for _ in range(3000):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 9)))
        pairs.append((a, mutate(rng, a, rng.randrange(0, 5))))
    df = spark.createDataFrame(pairs, "a STRING, b STRING")
    for r in df.withColumn("e", E.edits_within_two(F.col("a"), F.col("b"))).collect():
        want = damerau(r.a, r.b)
        assert r.e == (want if want <= 2 else None), (r.a, r.b)


class Vocabulary:
    def __init__(self, df):
        self.vocab = df


@pytest.mark.parametrize("seed", [1, 2])
def test_fuzzy_finds_every_match(spark, seed):
    """Short and long terms, and lengths around the change of method."""
    rng = random.Random(seed)
    terms = {
        "".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 3, 5, 6, 9, 14, 15, 16, 17, 18, 19, 25, 40])))
        for _ in range(60)
    }
    vocab = set(terms)
    for t in terms:
        for _ in range(6):
            vocab.add(mutate(rng, t, rng.randrange(1, 4)))
    vocab.discard("")
    voc = spark.createDataFrame([("f", t, 1 + len(t)) for t in vocab], "field STRING, term STRING, df BIGINT")
    asked = spark.createDataFrame([("f", t) for t in terms], "field STRING, qterm STRING")
    got = {
        (r.qterm, r.term, r.edits)
        for r in fuzzy.fuzzy_expand(Vocabulary(voc), asked, max_expansions=10**6).collect()
    }
    want = set()
    for q in terms:
        k = 0 if len(q) <= 2 else 1 if len(q) <= 5 else 2
        for t in vocab:
            e = damerau(q, t)
            if e <= k:
                want.add((q, t, e))
    assert got == want
