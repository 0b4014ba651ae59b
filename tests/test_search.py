import datetime as dt

import pytest
from pyspark.sql import functions as F

from findrift import session
from findrift.operators import matching as M
from findrift.operators import paging as P
from findrift.operators import similar as SM
from findrift.operators.index import open_index
from findrift.operators.requests import normalize_limits, normalize_requests
from findrift.plans import search as SE

DAY = dt.date(2001, 12, 31)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, set()).add(r.id)
    return out


def requests(spark, rows):
    return spark.createDataFrame(
        rows,
        "query_id BIGINT, query STRING, genres ARRAY<STRING>, rating_min DOUBLE, "
        "rating_max DOUBLE, page INT, page_size INT",
    )


def test_fuzziness_is_in_best_fields_only(index, ask):
    q = ask("harbuor")  # two letters swapped
    assert found(M.best_fields(index, q)) == {0: {"1", "2"}}
    assert found(M.cross_fields(index, q)) == {}


def test_exact_genre_keeps_case(index, ask):
    got = found(M.term_match(index, ask("Crime", "crime", "GLASS")))
    assert got == {0: {"3", "5"}, 2: {"2", "5"}}


def test_director_is_one_term(index, ask):
    got = found(M.cross_fields(index, ask("Ida Quill", "Ida")))
    assert got == {0: {"1", "2"}}


def test_phrase_does_not_cross_two_people(index, ask):
    # "Anna Bell", "Tower Marsh" hold both words, but not next to each other
    got = found(M.phrase_match(index, ask("bell tower", "night train", "train night")))
    assert got == {0: {"2"}, 1: {"3"}}


def test_phrase_slop(index, ask):
    rows = M.phrase_slop(index, ask("night train", "keeper waits", "train keeper runs", "late the")).collect()
    got = {(r.query_id, r.id): round(r.freq, 4) for r in rows}
    # "night train" next to each other once; in film 4 the words are 5 apart
    assert got[0, "3"] == 1.0 and (0, "4") not in got
    assert got[1, "3"] == 1.0
    assert got[3, "3"] == 1.0


def brute_phrase(tokens, words, slop):
    """Occurrences by trying every left edge."""
    starts = [[p - i for p, t in enumerate(tokens) if t == w] for i, w in enumerate(words)]
    total = 0.0
    for edge in sorted({s for xs in starts for s in xs}):
        near = [[s - edge for s in xs if 0 <= s - edge <= slop] for xs in starts]
        if not all(near):
            continue
        off = [min(x) for x in near]
        if min(off) == 0 and len({edge + o + i for i, o in enumerate(off)}) == len(words):
            total += 1 / (1 + max(off))
    return total


@pytest.mark.parametrize("seed", range(3))
def test_phrases_against_brute_force(spark, seed):
    import random

    from samples import film
    from findrift import schemas
    from findrift.operators.index import build_index

    rng = random.Random(seed)
    docs = {str(k): [rng.choice("abc") for _ in range(rng.randrange(1, 30))] for k in range(40)}
    rows = [film(k, " ".join(t), " ".join(t)) for k, t in docs.items()]
    ix = build_index(
        spark.createDataFrame(rows, schemas.CATALOG), session.workspace(spark, "phrases-test"), 2
    )
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 2, 3, 3, 4)]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id BIGINT, query STRING")
    for df, slop in ((M.phrase_match(ix, q).where("field = 'title'"), 0), (M.phrase_slop(ix, q), 2)):
        got = {(r.query_id, r.id): round(r.freq, 6) for r in df.collect()}
        want = {}
        for i, text in enumerate(texts):
            for k, toks in docs.items():
                f = brute_phrase(toks, text.split(), slop)
                if f:
                    want[i, k] = round(f, 6)
        assert got == want


def test_unscored_matches_are_all_matches(index, ask):
    q = ask("quiet train", "Ida Quill", "GLASS", "Crime", "harbuor of", "the late night")
    assert found(M.bool_matches(index, q)) == found(M.bool_should(index, q))


def all_outputs(job):
    return (
        sorted(map(tuple, job.hits("title").collect())),
        sorted(map(tuple, job.totals().collect())),
        sorted(map(tuple, job.facets().collect())),
    )


ROWS = [
    (1, "quiet train", None, None, None, 1, 2),
    (2, "quiet train", None, None, None, 2, 2),
    (3, "quiet train", ["Drama"], None, None, 1, 50),
    (4, " ", None, None, None, 1, 2),
    (5, "", ["Drama", "Crime"], 5.0, 7.9, 1, 50),
    (6, "nothinglikeit", None, None, None, 1, 10),
    (7, "quiet train", None, 7.0, None, 1, 50),
]


def test_pages(spark, index):
    job = SE.search(index, requests(spark, ROWS), DAY)
    hits = {}
    for r in job.hits().collect():
        hits.setdefault(r.query_id, []).append((r.rank, r.id))
    first, second = ([i for _, i in sorted(hits[k])] for k in (1, 2))
    assert len(first) == 2 and not set(first) & set(second)
    both = [r.id for r in sorted(job.hits(cumulative=True).where("query_id = 2").collect(), key=lambda r: r.rank)]
    assert both == first + second
    totals = {r.query_id: (r.total, r.has_more) for r in job.totals().collect()}
    assert totals[1][0] == totals[2][0] and totals[1][1] is True and totals[2][1] is False
    assert totals[6] == (0, False)
    assert totals[4] == (6, True)
    # ratings 5.0 to 7.9 in Drama or Crime: films 1, 2, 4
    assert totals[5] == (3, False)
    assert totals[7] == (1, False)


def test_facets_ignore_filters_and_count_once(spark, index):
    facets = {}
    for r in SE.search(index, requests(spark, ROWS), DAY).facets().collect():
        facets.setdefault(r.query_id, {})[r.genre] = r.doc_count
    assert facets[1] == facets[3] == facets[7]
    assert facets[4] == facets[5] == {"Drama": 4, "Crime": 2, "Mystery": 1, "Comedy": 1}
    assert 6 not in facets


def test_one_query_or_many(spark, index):
    many = SE.search(index, requests(spark, ROWS), DAY).hits().where("query_id = 3").collect()
    one = SE.search(index, requests(spark, [ROWS[2]]), DAY).hits().collect()
    assert sorted(many) == sorted(one)


def test_repeated_requests_share_their_work(spark, index):
    rows = [(100 + i, *ROWS[0][1:]) for i in range(30)] + [ROWS[2]]
    plan = SE.plan_requests(requests(spark, rows))
    assert plan.texts.count() == 1 and plan.signatures.count() == 2
    hits = SE.search(index, requests(spark, rows), DAY).hits()
    assert {r["count"] for r in hits.where("query_id >= 100").groupBy("query_id").count().collect()} == {2}


def test_stored_matches_give_the_same(spark, index):
    r = requests(spark, ROWS)
    assert all_outputs(SE.search(index, r, DAY)) == all_outputs(SE.search(index, r, DAY, store_matches=True))


def test_without_broadcast(spark, index, ask):
    """Joins that the planner shuffles give the same results."""
    r = requests(spark, ROWS)
    sim = normalize_limits(
        spark.createDataFrame([(1, "1", None), (2, "4", "3")], "query_id INT, anchor STRING, limit STRING")
    )
    want = all_outputs(SE.search(index, r, DAY))
    similar = sorted(map(tuple, SM.similar_docs(index, sim).collect()))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert all_outputs(SE.search(index, r, DAY)) == want
        assert sorted(map(tuple, SM.similar_docs(index, sim).collect())) == similar
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_reopened_index(spark, index, ask):
    again = open_index(spark, index.path, index.buckets)
    q = ask("quiet train", "glass")
    rows = lambda ix: sorted((r.query_id, r.id, round(r.score, 9)) for r in M.bool_should(ix, q).collect())
    assert rows(again) == rows(index)


def test_similar(spark, index):
    req = normalize_limits(
        spark.createDataFrame(
            [(1, "3", "1"), (2, "3", "99"), (3, "none", None)], "query_id INT, anchor STRING, limit STRING"
        )
    )
    got = {}
    for r in SM.similar_docs(index, req).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    assert got[1] == [(1, "4")]
    assert "3" not in [i for _, i in got[2]]
    assert 3 not in got


def test_bands_equal_plain_ranking(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3).alias("k"), F.col("id"),
        F.when(F.col("id") % 3 == 2, 1.0).otherwise((F.col("id") * 37) % 101 / 7 - 3).alias("score"),
    )
    a = {(r.k, r.rank): r.id for r in P.rank_all(df, "k").collect()}
    b = {(r.k, r.rank): r.id for r in P.top_per_key(df, "k", 900).collect()}
    assert len(a) == 5000 and all(a[key] == v for key, v in b.items())
    assert {r for k, r in a if k == 0} == set(range(1, 1668))


def test_normalize_requests(spark):
    raw = spark.createDataFrame(
        [
            (1, None, ",,", "", "x", None, None),
            (2, " q ", "A,,b", "5.5abc", "-1", "0", "900"),
            (3, "q", None, ".5", "1e1", "7x", "0"),
        ],
        "query_id INT, q STRING, genres STRING, ratingMin STRING, ratingMax STRING, page STRING, pageSize STRING",
    )
    got = [tuple(r) for r in normalize_requests(raw).orderBy("query_id").collect()]
    assert got == [
        (1, "", None, None, None, 1, 24),
        (2, " q ", ["A", "b"], 5.5, -1.0, 1, 50),
        (3, "q", None, 0.5, 10.0, 7, 1),
    ]


def test_similar_to_copies(spark):
    """Copies of a text are scored once and still left out of their own lists."""
    from samples import FILMS
    from findrift import schemas
    from findrift.operators.index import build_index

    copies = [dict(FILMS[2], id=f"c{k:02}") for k in range(25)]
    ix = build_index(
        spark.createDataFrame(FILMS + copies, schemas.CATALOG),
        session.workspace(spark, "copies-test"), 2,
    )
    asked = [(k, f"c{k:02}", "20") for k in range(25)] + [(99, "3", "20")]
    req = normalize_limits(spark.createDataFrame(asked, "query_id INT, anchor STRING, limit STRING"))
    got = {}
    for r in SM.similar_docs(ix, req).collect():
        got.setdefault(r.anchor, {})[r.rank] = r.id
    assert len(got) == 26
    everyone = ["3"] + [f"c{k:02}" for k in range(25)]
    for anchor, ranks in got.items():
        want = [i for i in everyone if i != anchor][:20]
        assert [ranks[k] for k in range(1, 21)] == want, anchor
