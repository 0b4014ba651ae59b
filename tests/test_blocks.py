"""Work on blocks of documents against the same work on rows."""

import pytest
from pyspark.sql import functions as F

from findrift import schemas, session
from findrift.operators import analysis as A
from findrift.operators import matching as M
from findrift.operators.index import buckets_for, postings
from samples import FILMS, film

ODD = [
    *FILMS, FILMS[0], film("1", "Quiet again", "A light light.", cast=["Marsh Tower"], genres=["Drama", None]),
    film("7", None, None, genres=None, keywords=None, director=None), film(None, "No id", "glass"),
]
THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.mark.parametrize("by_term", [False, True])
def test_postings_are_those_of_rows_of_words(spark, by_term):
    docs = spark.createDataFrame(ODD, schemas.CATALOG).repartition(3, "id")
    want = A.tokens(docs).groupBy("id", "field", "term").agg(
        F.count(F.lit(1)).cast("int"), F.max("dl"), F.sort_array(F.collect_list("pos"))
    )
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    got = postings(docs, by_term)
    assert rows(got) == rows(want)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_bucket_fits_a_task():
    """The postings of 512 MB were sorted in one task, which wrote them to disk several times."""
    assert buckets_for(1 << 30, 6) >= 64 and buckets_for(0, 6) == 6


def test_phrases_read_other_words_at_likely_documents_only(index, ask):
    """A phrase's words after the rarest two are looked up in documents that have those."""
    plan = M.phrase_slop(index, ask("the quiet train keeper waits"))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("job", [M.best_fields, M.cross_fields, M.bm25_match, M.bool_should, M.bool_matches])
def test_many_coefficients_give_the_same_scores_and_move_no_postings(spark, index, ask, job):
    texts = ["quiet train", "glass keeper", "night train night train", "Ida Quill", "GLASS", "Crime", "the nigth tain"]
    queries = ask(*texts).union(ask(*texts).where("query_id = 1"))
    rows = lambda: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in job(index, queries).collect())
    few = rows()
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "1")
    try:
        assert rows() == few and few
        plan = job(index, queries)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set(THRESHOLD, before)


def test_similar_words_are_found_without_moving_the_vocabulary(spark, index, ask):
    """Keys of the vocabulary, some fifty for a word, are not shuffled when the keys of the query side are few bytes."""
    from findrift.operators.fuzzy import fuzzy_expand

    spark.conf.set(THRESHOLD, "1")
    try:
        terms = M.fuzzy_terms(ask("quiet train")).select("field", "qterm")
        assert session._threshold(spark) == 1
        plan = fuzzy_expand(index, terms)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2
    finally:
        spark.conf.set(THRESHOLD, "10485760b")


def test_pages_beyond_the_matches_are_counted_not_ranked(spark, index):
    """A page far beyond the matches needs no rank; all pages up to it do."""
    import datetime as dt

    from findrift.plans import search as SE
    from test_search import requests

    rows = [(0, "train", None, None, None, 1, 2), (1, "quiet", None, None, None, 10**8, 50), (2, "", None, None, None, 3, 2), (3, "", ["Drama"], None, None, 10**8, 50)]
    job = SE.search(index, requests(spark, rows), dt.date(2001, 12, 31))
    assert "_band" not in job.ranked(cumulative=False)._jdf.queryExecution().toString()
    count = lambda df: {r.query_id: r["count"] for r in df.groupBy("query_id").count().collect()}
    assert count(job.hits()) == {0: 2, 2: 2}
    totals = {r.query_id: r.total for r in job.totals().collect()}
    assert count(job.hits(cumulative=True)) == {0: 2, 1: totals[1], 2: 6, 3: totals[3]}
