import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from checks import bindings as B
from checks import queries as Q
from samples import SF
from findrift import schemas, session
from findrift.functions.dates import lenient_date
from findrift.functions.display import display_columns, runtime_text
from findrift.operators.requests import normalize_limits, normalize_requests
from findrift.operators.paging import best_rows
from findrift.plans.catalog_load import load_catalog
from findrift.sources import bulk as BK
from findrift.sources import details as D
from findrift.sources import exports as X
from findrift.sources import tables as TB
from findrift.streaming import streams as ST

DAY = dt.date(2001, 12, 31)


def new(spark):
    return session.workspace(spark, "test")


def test_dates(spark):
    texts = ["1994-09-23", "1994", "785000000000", "not", "", None, "1994-13-01", "1994-9-3"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r.d and str(r.d) for r in df.select(lenient_date(F.col("t")).alias("d")).collect()]
    assert got == ["1994-09-23", "1994-01-01", "1994-11-16", None, None, None, None, None]


def write_export(spark, root, day, rows):
    spark.createDataFrame(rows, schemas.ID_EXPORT).write.option("compression", "gzip").json(f"{root}/dt={day}")


def test_latest_snapshot(spark):
    root = new(spark)
    write_export(spark, root, "2001-12-20", [(1, 1.0)])
    with pytest.raises(LookupError):
        X.latest_snapshot(spark, root, DAY)
    write_export(spark, root, "2001-12-25", [(2, 1.0)])
    write_export(spark, root, "2002-01-01", [(3, 1.0)])
    assert [r.id for r in X.latest_snapshot(spark, root, DAY).collect()] == [2]


def detail(id, **more):
    row = {
        "id": id, "title": f"t{id}", "genres": [{"id": 1, "name": "Drama"}], "popularity": 2,
        "keywords": {"keywords": [{"name": "sea"}]},
        "credits": {
            "cast": [{"name": f"p{k}", "order": k} for k in range(12)],
            "crew": [{"name": "w", "job": "Writer"}, {"name": "d", "job": "Director"},
                     {"name": "e", "job": "Director"}],
        },
    }
    row.update(more)
    return json.dumps(row)


def test_catalog_load(spark):
    root, raw, out = new(spark), new(spark), new(spark)
    write_export(spark, root, "2001-12-30", [(1, 5.0), (2, 9.0), (3, 0.0), (4, 1.0), (5, 2.0), (6, None), (7, 3.0)])
    lines = [detail(1), detail(2, credits={}, genres=[]), detail(3), detail(4, genres="x"),
             detail(5, status_code=34), detail(7, status_code=0)]
    spark.createDataFrame([(x,) for x in lines], "value STRING").write.text(raw)
    load = load_catalog(spark, root, raw, out, DAY)
    got = {r.id: r for r in load.catalog.collect()}
    assert set(got) == {"1", "2", "7"}
    assert got["1"].director == "d" and [c.name for c in got["1"].cast] == [f"p{k}" for k in range(10)]
    assert got["2"].director == "" and got["2"].genres == [] and got["2"].cast == []
    assert got["1"].tagline == "" and got["1"].budget == 0 and got["1"].cast[0].character == ""
    assert tuple(load.tallies.first()) == (5, 3, 2)
    assert {(r.id, r.reason) for r in load.rejects.collect()} == {(4, "malformed"), (5, "error document")}


def test_shape_is_judged_whatever_is_selected(spark):
    raw = new(spark)
    spark.createDataFrame([(detail(1),), (detail(2, genres="x"),)], "value STRING").write.text(raw)
    usable = D.accepted(D.detail_scan(spark, raw))
    assert [r.id for r in usable.select("id").collect()] == [1]


def test_bulk_round_trip(spark):
    path = new(spark)
    rows = [("a", 'He said {"x": 1}\n and left', 1.5), ("b", "é", None)]
    df = spark.createDataFrame(rows, "id STRING, title STRING, popularity DOUBLE")
    BK.write_bulk_pairs(df, path, batch=1, index="films", id_column="id")
    back = BK.bulk_pairs_scan(spark, path, "title STRING, popularity DOUBLE")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_bulk_without_ids(spark):
    df = spark.createDataFrame([(1,)], "n INT")
    assert BK.bulk_lines(df).first().value == '{"index":{}}\n{"n":1}'


def test_upsert(spark):
    base = spark.createDataFrame([("1", "a"), ("2", "b")], "id STRING, title STRING")
    delta = spark.createDataFrame(
        [("2", "c", 1), ("2", "d", 2), ("3", "e", 1)], "id STRING, title STRING, seq INT"
    )
    got = sorted(map(tuple, TB.upsert_by_id(base, delta).collect()))
    assert got == [("1", "a"), ("2", "d"), ("3", "e")]


def test_generated_ids_are_unique_in_one_millisecond(spark):
    rows = spark.range(3000).withColumn("at", F.lit(dt.datetime(2001, 1, 1)))
    ids = TB.with_generated_ids(rows.withColumnRenamed("id", "n"), "at", "n")
    assert ids.select("id").distinct().count() == 3000


def test_refresh_conforms(spark):
    path = new(spark)
    TB.refresh_table(spark.createDataFrame([("1", 7)], "id STRING, junk INT"), path, schemas.CATALOG)
    TB.refresh_table(spark.createDataFrame([("2", 7)], "id STRING, junk INT"), path, schemas.CATALOG)
    got = spark.read.parquet(path)
    assert [r.id for r in got.collect()] == ["2"] and "junk" not in got.columns


def test_ensure_table_keeps_rows(spark):
    path = new(spark)
    TB.ensure_table(spark, "kept_table", "a INT", path)
    spark.createDataFrame([(1,)], "a INT").write.mode("append").parquet(path)
    spark.sql("REFRESH TABLE kept_table")
    assert TB.ensure_table(spark, "kept_table", "a INT", path).count() == 1


def test_display(spark, films):
    from findrift.operators.index import index_docs

    df = index_docs(films).withColumn("poster_path", F.lit("/p.jpg"))
    shown = display_columns("base")
    r = df.where("id = '1'").select(*[c.alias(n) for n, c in shown.items()]).first()
    assert (r.year, r.stars, r.rating, r.runtime_text) == (2001, 3, 5.0, "1h 30m")
    assert (r.language, r.cast_initial, r.card_image, r.wide_image) == ("EN", "A", "base/w342/p.jpg", None)
    got = spark.sql("SELECT 45 m UNION ALL SELECT 60").select(runtime_text(F.col("m")).alias("x")).collect()
    assert {x.x for x in got} == {"45m", "1h 0m"}


def test_stream_upsert_survives_a_repeated_batch(spark):
    landed, deltas, state = new(spark), new(spark), new(spark)
    schema = "id STRING, title STRING, seq INT"
    spark.createDataFrame([("2", "c", 1), ("2", "d", 2)], schema).coalesce(1).write.json(landed)
    arrivals = spark.readStream.schema(schema).json(landed)
    ST.upsert_arrivals(arrivals, deltas, state, drain=True).awaitTermination()
    base = spark.createDataFrame([("1", "a"), ("2", "b")], "id STRING, title STRING")
    # a second run from an empty state stores the same batch number again
    ST.upsert_arrivals(arrivals, deltas, new(spark), drain=True).awaitTermination()
    got = sorted(map(tuple, ST.current(base, deltas).collect()))
    assert got == [("1", "a"), ("2", "d")]
    out = new(spark)
    ST.compact(base, deltas, out, "id STRING, title STRING")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == got


def test_stream_drops_repeats(spark):
    landed, out = new(spark), new(spark)
    rows = spark.sql("SELECT id AS event_id, timestamp_seconds(1000000000 + id * 600) AS ts, 'x' AS event_type FROM range(200)")
    for lo in (0, 100):
        for _ in range(3):
            rows.where(f"event_id between {lo} and {lo + 99}").coalesce(1).write.mode("append").json(landed)
    read = ST.read_logs(spark, landed, schemas.EVENT, files_per_batch=1)
    ST.append_logs(ST.once_per_key(read, "event_id", "ts", "1 hour"), "ts", out, new(spark), drain=True).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(200))


def test_numbers_of_any_length(spark):
    rows = [(1, "99999999999", "99999999999"), (2, "9" * 400, "-5"), (3, "abc", None), (4, " 3x", "0")]
    raw = spark.createDataFrame(
        [(i, None, None, None, None, p, s) for i, p, s in rows],
        "query_id INT, q STRING, genres STRING, ratingMin STRING, ratingMax STRING, page STRING, pageSize STRING",
    )
    got = {r.query_id: (r.page, r.page_size) for r in normalize_requests(raw).collect()}
    assert got == {1: (99999999999, 50), 2: (10**15, 1), 3: (1, 24), 4: (3, 1)}
    limits = spark.createDataFrame([(1, "3000000000"), (2, "-1"), (3, None)], "query_id INT, limit STRING")
    assert [r["limit"] for r in normalize_limits(limits).orderBy("query_id").collect()] == [20, 1, 8]


def test_bulk_documents_that_look_like_actions(spark):
    path = new(spark)
    lines = [
        '{"index":{"_id":"1"}}', '{"index":{"x":1},"title":"a"}', '{ "create" : {"_id":"2"}}', '{"title":"b"}',
        "", '{"index":{}}', '{"index":{"_id":"9"}}', '{"index":{"_id":"4"}}', '{"title":"d"}',
    ]
    spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.text(path)
    got = BK.bulk_pairs_scan(spark, path, "title STRING").collect()
    assert sorted(((r._id, r.title) for r in got), key=str) == [("1", "a"), ("2", "b"), ("4", "d"), (None, None)]


def test_generated_ids_of_two_batches(spark):
    rows = spark.sql("SELECT id AS n, timestamp'2020-01-01' AS t FROM range(100)")
    a, b = (TB.with_generated_ids(rows.where(f"n % 2 = {k}"), "t", "n") for k in (0, 1))
    assert a.unionByName(b).select("id").distinct().count() == 100


def test_numbers_that_are_no_date(spark):
    rows = [("9223372036854775807", None), ("-9223372036854775808", None), ("951782400000", "2000-02-29"), ("99999999999999999999", None)]
    df = spark.createDataFrame(rows, "t STRING, want STRING")
    assert all(str(r.got) == str(r.want) for r in df.select("want", lenient_date(F.col("t")).alias("got")).collect())


def test_a_slice_of_events_lands_in_parallel(spark, monkeypatch):
    whole = B.events(spark, SF).repartition(4)
    monkeypatch.setattr(B, "events", lambda spark, sf: whole)
    files = [len(spark.read.json(path).inputFiles()) for path in B.land_events(spark, SF, 1)]
    assert len(files) == B.SLICES and files[0] > 1 and files == sorted(files)
    ids = [r.event_id for r in whole.select("event_id").distinct().collect()]
    got = [r.event_id for r in Q.stream_dedupe(spark, SF).select("event_id").collect()]
    assert sorted(got) == sorted(ids)


@pytest.mark.parametrize("scores", ["distinct", "equal", "two", "skewed", "few"])
@pytest.mark.parametrize("limit", [0, 1, 7, 250, 999, 5000])
def test_best_rows_without_a_merge(spark, scores, limit):
    value = {
        "distinct": "(id * 7919) % 1000 / 3", "equal": "2.5D", "two": "if(id % 10 = 0, 9.0D, 1.0D)",
        "skewed": "if(id < 3, pow(10, 12 - id), id % 5 / 1e6)", "few": "cast(id % 4 as double)",
    }[scores]
    df = spark.range(0, 1000, 1, 7).selectExpr("id", f"cast({value} as double) as score")
    rows = sorted(((r.score, r.id) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    got = [(r.score, r.id) for r in best_rows(df, "score", "id", limit).collect()]
    assert sorted(got, key=lambda r: (-r[0], r[1])) == rows[:limit]


def test_best_rows_plan(spark):
    df = best_rows(spark.range(1000).selectExpr("id", "1D as score"), "score", "id", 10)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in text and "GlobalLimit" not in text and "SinglePartition" not in text
