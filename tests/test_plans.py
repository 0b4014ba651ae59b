"""What the physical plans must and must not contain."""

import datetime as dt
import re

import pytest

from checks import bindings as B
from samples import SF
from findrift import session
from findrift.operators import matching as M
from findrift.operators.index import postings
from findrift.plans import search as SE
from test_search import ROWS, requests

DAY = dt.date(2001, 12, 31)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_need_no_shuffle(index, ask):
    text = plan(M.best_fields(index, ask("quiet train")))
    assert "BroadcastHashJoin" in text and "Bucketed: true" in text
    assert "Exchange hashpartitioning" not in text


def test_phrases_need_no_shuffle(index, ask):
    assert "Exchange hashpartitioning" not in plan(M.phrase_slop(index, ask("quiet train")))


def test_positions_are_read_for_phrases_only(index, ask):
    assert "positions" not in plan(M.best_fields(index, ask("quiet train")))


def test_postings_come_from_stored_documents_without_shuffle(index):
    assert "Exchange" not in plan(postings(index.docs))


@pytest.mark.parametrize("requests", [1, 1000])
def test_few_terms_read_few_ranges(spark, requests):
    """Partitions of postings are cut down by the terms at run time, whatever the number of requests."""
    index = B.index(spark, SF)
    word = index.vocab.where("field = 'overview'").orderBy("df", "term", ascending=False).first().term
    texts = spark.range(requests).selectExpr("id as query_id", f"concat('{word} w', id % 7) as query")
    df = M.bm25_match(index, texts)
    text = plan(df)
    assert "dynamicpruning" in text and "NestedLoop" not in text
    whole = index.postings.select("term", "tf")
    assert 0 < files_read(df) < files_read(whole) / 2


def files_read(df):
    """Files that scans of bucketed tables read in a run, by the session's own metrics."""
    spark = df.sparkSession
    df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    run = max(runs.apply(i).executionId() for i in range(runs.size()))
    values, nodes, total = store.executionMetrics(run), store.planGraph(run).allNodes(), 0
    for i in range(nodes.size()):
        if nodes.apply(i).name().startswith("Scan parquet spark_catalog"):
            metrics = nodes.apply(i).metrics()
            for j in range(metrics.size()):
                m = metrics.apply(j)
                if m.name() == "number of files read":
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_boolean_query_moves_nothing(spark, ask):
    # postings larger than the query side, so that the planner leaves them in place
    text = plan(M.bool_should(B.index(spark, SF), ask("quiet train")))
    assert "Exchange hashpartitioning" not in text


def test_strict_sessions_give_the_same_scores(spark, index, ask):
    q = ask("quiet train", "glass keeper", "night train")
    rows = lambda: sorted((r.query_id, r.id, round(r.score, 6)) for r in M.bool_should(index, q).collect())
    own = rows()
    spark.conf.set(session.JOIN_BY_ALL_KEYS, "true")
    try:
        assert rows() == own and own
    finally:
        spark.conf.set(session.JOIN_BY_ALL_KEYS, "false")


def test_unscored_matches_need_no_shuffle(index, ask):
    assert "Exchange hashpartitioning" not in plan(M.bool_matches(index, ask("quiet train")))


@pytest.mark.parametrize("output", ["hits", "totals", "facets"])
def test_search_plans(spark, index, output):
    job = SE.search(index, requests(spark, ROWS), DAY)
    text = plan(getattr(job, output)())
    assert "NestedLoop" not in text and "Cartesian" not in text
    if output == "hits":
        assert re.search(r"WindowGroupLimit .*Partial", text)
