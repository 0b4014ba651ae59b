import re

from pyspark.sql import functions as F

from findrift.llm import rules
from odd_rows import ODD


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^ \t\n\x0b\x0c\r]", x)]
    seen, covered = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(p + j for p in at for j in range(5))
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_measurements(spark, odd):
    more = [(100, "a b c d e x a b c d e"), (101, "p q\np q\n\n \np q"), (102, "a a a a a a a"), (103, "#$ <b> x|y")]
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id bigint, text string"))
    docs = docs.withColumn("k", F.monotonically_increasing_id())
    texts = {r["k"]: r["text"] for r in docs.collect()}
    got = rules.ledger(docs, ["k"]).collect()
    assert len(got) == len(ODD) + len(more)
    for r in got:
        assert {c: r[c] for c in brute("")} == brute(texts[r["k"]]), texts[r["k"]][:60]


def test_bits_and_policies(spark):
    rows = [(1, "too short"), (2, "word " * 40), (3, " ".join(f"w{i}" for i in range(30))),
            (4, " ".join(f"W{chr(65 + i % 26)}X" for i in range(30)))]
    book = rules.ledger(spark.createDataFrame(rows, "doc_id int, text string"))
    got = {r["doc_id"]: r for r in book.select("*", rules.fails(rules.BASE).alias("b"), rules.fails(rules.PRODUCTION).alias("p")).collect()}
    bit = {r: 1 << k for k, r in enumerate(rules.RULES)}
    assert got[1]["failed"] & bit["few_words"] and got[1]["b"]
    assert got[2]["failed"] & bit["repeated_words"] and got[2]["b"]
    assert not got[3]["b"] and not got[3]["p"]
    assert got[4]["failed"] & bit["upper_case"] and got[4]["p"] and not got[4]["b"]


def test_ablations_equal_counting(spark, odd):
    book = rules.ledger(odd, ["doc_id"]).cache()
    rows = [r["failed"] for r in book.collect()]
    for r in rules.ablations(book, [rules.BASE, rules.PRODUCTION]).collect():
        mask = {"base": rules.BASE, "production": rules.PRODUCTION}[r["policy"]].mask
        bit = 1 << rules.RULES.index(r["rule"])
        assert r["rejected"] == sum(bool(x & bit) for x in rows)
        assert r["only_this"] == sum(x & mask == bit for x in rows)


def test_keep_returns_the_rows_as_they_were(odd, none):
    kept = rules.keep(odd, rules.BASE)
    assert kept.columns == odd.columns
    want = [i for i, t in ODD if (b := brute(t))["n_words"] >= 10 and 100 * b["n_repeat_words"] <= 20 * b["n_words"]]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert rules.keep(none).count() == 0


def test_no_shuffle_and_no_python(odd):
    plan = rules.keep(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
