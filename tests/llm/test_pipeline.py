from findrift.llm import rules
from test_jaccard import brute

import corpus_pipeline
from odd_rows import SF


def test_stages_on_the_supplied_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "quality":
            book = rules.ledger(spark.createDataFrame(before), ["doc_id"])
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in book.where(~rules.fails(rules.PRODUCTION)).collect()}
        if name == "near_duplicates":
            low = {i: c for i, _, c in brute([(r["doc_id"], r["text"]) for r in before])}
            assert {r["doc_id"] for r in after} == {i for i, c in low.items() if i == c}
        if name == "packing":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
