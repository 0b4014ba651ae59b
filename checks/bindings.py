"""The supplied tables seen as a catalogue, requests and logs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift import session
from findrift.operators.index import Index, buckets_for, build_index
from findrift.operators.requests import normalize_limits, normalize_requests

AS_OF = dt.date(2001, 12, 31)

_built: dict[tuple, Index] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` with `part`, `lineitem` and `labels` as a film-like catalogue."""
    lines = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("id"))
        .agg(
            F.count(F.lit(1)).cast("int").alias("vote_count"),
            F.round(F.avg("l_quantity") / 5, 4).alias("vote_average"),
        )
    )
    parts = table(spark, sf, "part").withColumnRenamed("p_partkey", "id")
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    docs = table(spark, sf, "documents").repartition("doc_id").select(
        F.col("doc_id").alias("id"), "text", "lang", "source", F.split("text", r"\s+").alias("w")
    )

    def span(start: int, n: int):
        return F.array_join(F.slice("w", start, n), " ")

    def person(start: int, order: int):
        return F.struct(
            span(start, 2).alias("name"), F.lit("").alias("character"),
            F.lit(order).cast("bigint").alias("order"), F.lit("").alias("profile_path"),
        )

    none = F.array().cast("array<string>")
    day = F.date_add(F.lit(dt.date(1995, 1, 1)), (F.col("id") * 37 % 2400).cast("int"))
    return (
        docs.join(parts, "id", "left").join(lines, "id", "left").join(labels, "id", "left")
        .select(
            "id",
            span(1, 5).alias("title"),
            F.col("text").alias("overview"),
            F.when(F.col("id") % 17 == 0, "")
            .when(F.col("id") % 19 == 0, "1998")
            .when(F.col("id") % 23 == 0, "not-a-date")
            .when(F.col("id") % 41 == 0, "9223372036854775807")
            .when(F.col("id") % 43 == 0, F.concat(F.lit("9517"), F.col("id").cast("string"), F.lit("00000")))
            .otherwise(F.date_format(day, "yyyy-MM-dd")).alias("release_date"),
            "vote_average", "vote_count",
            F.when(F.col("id") % 13 != 0, F.round(F.col("p_retailprice") / 10, 4)).alias("popularity"),
            F.concat(
                F.array("source", "lang"),
                F.when(F.col("quality") == 1, F.array(F.lit("quality"))).otherwise(none),
                F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(none),
            ).alias("genres"),
            (F.col("p_size") * 4).alias("runtime"),
            F.col("lang").alias("original_language"),
            span(6, 4).alias("tagline"),
            F.split("p_name", " ").alias("keywords"),
            F.array(person(10, 0), person(13, 1)).alias("cast"),
            F.col("p_brand").alias("director"),
        )
    )


def raw_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Two search requests per `benchmark` row, as text parameters.

    Even query ids ask for the whole text; odd ones are blank, an exact value or some of the words.
    """
    w = F.split("text", r"\s+")
    k = F.col("item_id") % 10
    i = F.col("item_id")

    def span(start: int, n: int):
        return F.array_join(F.slice(w, start, n), " ")

    short = (
        F.when(k == 0, "  ").when(k == 1, "en").when(k == 2, "RED").when(k == 3, "Brand#13")
        .when(k == 4, span(1, 1)).when(k == 5, span(1, 5)).otherwise(span(2, 3))
    )
    forms = F.posexplode(F.array(F.col("text"), short)).alias("form", "q")
    return table(spark, sf, "benchmark").select("item_id", forms).select(
        (i * 2 + F.col("form")).alias("query_id"),
        "q",
        F.when(i % 3 == 0, "en,,src1").alias("genres"),
        F.when(i % 4 == 0, "5.0").when(i % 4 == 1, "abc").alias("ratingMin"),
        F.when(i % 5 == 0, "6").alias("ratingMax"),
        F.when(i % 7 == 0, "2").when(i % 7 == 1, "0").when(i % 7 == 2, "99999999999")
        .when(i % 11 == 3, "9" * 400).alias("page"),
        F.when(i % 6 == 0, "10").when(i % 6 == 1, "500").when(i % 6 == 2, "99999999999").alias("pageSize"),
    )


def fingerprint(spark: SparkSession, sf: str) -> tuple:
    """State of the input files, so that a changed input is never served from an old index."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        [f"{sf}/{t}.parquet" for t in ("documents", "part", "lineitem", "labels")]
    )
    r = files.agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"), F.max("modificationTime").alias("m")
    ).first()
    return (r.n, r.b, str(r.m))


def index(spark: SparkSession, sf: str) -> Index:
    """The index of the catalogue, written once per session and input state."""
    state = fingerprint(spark, sf)
    key = (spark.sparkContext.applicationId, sf, state)
    if key not in _built:
        n = buckets_for(state[1], spark.sparkContext.defaultParallelism)
        _built[key] = build_index(catalog(spark, sf), session.workspace(spark, "index"), n)
    return _built[key]


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_requests(raw_requests(spark, sf))


def keyword_queries(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query) of the requests that are not blank."""
    return requests(spark, sf).where(F.trim("query") != "").select("query_id", "query")


def raw_limits(spark: SparkSession, sf: str) -> DataFrame:
    """One request per document, and one for an unknown document per `benchmark` row."""
    unknown = table(spark, sf, "benchmark").select((F.col("item_id") * 20 + 1_000_000_000).alias("anchor"))
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("anchor")).unionAll(unknown)
    i = F.expr("anchor div 20")
    return asked.select(
        F.col("anchor").alias("query_id"), "anchor",
        F.when(i % 4 == 0, "50").when(i % 4 == 1, "0").when(i % 4 == 2, "x")
        .when(i % 8 == 3, "3000000000").alias("limit"),
    )


def id_requests(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_limits(raw_limits(spark, sf))


def similar_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The requests whose id is divisible by 20 are the queries of a search over all documents."""
    return id_requests(spark, sf).where(F.col("anchor") % 20 == 0)


def id_export(spark: SparkSession, sf: str) -> DataFrame:
    """`part` as an id export; some ids have no popularity above zero."""
    price = F.when(F.col("p_partkey") % 11 == 0, 0.0).otherwise(F.col("p_retailprice"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), price.alias("popularity"))


def write_exports(spark: SparkSession, sf: str) -> str:
    """Three daily exports of all ids, of which the newest is two days old."""
    root = session.workspace(spark, "exports")
    for age in (2, 5, 9):
        day = AS_OF - dt.timedelta(days=age)
        aged = id_export(spark, sf).withColumn("popularity", F.col("popularity") * age)
        aged.write.option("compression", "gzip").json(f"{root}/dt={day}")
    return root


def raw_details(spark: SparkSession, sf: str) -> DataFrame:
    """(value): the catalogue as raw JSON records, some of them errors or malformed."""
    docs = catalog(spark, sf)
    w = F.split("overview", r"\s+")
    named = lambda xs: F.transform(xs, lambda g: F.struct(g.alias("name")))
    member = F.transform(
        F.sequence(F.lit(0), F.lit(11)),
        lambda k: F.struct(
            F.array_join(F.slice(w, k * 2 + 1, F.lit(2)), " ").alias("name"),
            F.when(k % 3 != 0, F.concat(F.lit("role "), k.cast("string"))).alias("character"),
            k.cast("bigint").alias("order"),
        ),
    )
    crew = F.concat(
        F.array(F.struct(F.lit("first writer").alias("name"), F.lit("Writer").alias("job"))),
        F.when(
            F.col("id") % 7 != 0,
            F.array(
                F.struct(F.col("director").alias("name"), F.lit("Director").alias("job")),
                F.struct(F.lit("second unit").alias("name"), F.lit("Director").alias("job")),
            ),
        ).otherwise(F.array().cast("array<struct<name:string,job:string>>")),
    )
    record = F.to_json(
        F.struct(
            "id", "title", "overview", "release_date", "vote_average", "vote_count", "popularity",
            named(F.col("genres")).alias("genres"), "runtime", "original_language", "tagline",
            F.struct(named(F.col("keywords")).alias("keywords")).alias("keywords"),
            F.struct(member.alias("cast"), crew.alias("crew")).alias("credits"),
            F.when(F.col("id") % 29 == 0, 34).alias("status_code"),
        )
    )
    broken = F.replace(record, F.lit('"genres":['), F.lit('"genres":7,"others":['))
    return docs.select(F.when(F.col("id") % 31 == 0, broken).otherwise(record).alias("value"))


def write_details(spark: SparkSession, sf: str) -> str:
    path = session.workspace(spark, "details")
    raw_details(spark, sf).write.text(path)
    return path


def delta(spark: SparkSession, sf: str) -> DataFrame:
    """Two new versions of every labelled document, and a new one per benchmark item."""
    labelled = (
        catalog(spark, sf)
        .join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
        .select("id", "title", "director")
    )
    fresh = table(spark, sf, "benchmark").select(
        (F.col("item_id") + 1_000_000_000).alias("id"), F.col("text").alias("title"),
        F.lit("new").alias("director"),
    )
    version = F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")
    return labelled.unionByName(fresh).select("*", version).select(
        "id", F.concat("title", F.lit(" v"), F.col("seq").cast("string")).alias("title"),
        "director", "seq",
    )


def bulk_responses(spark: SparkSession, sf: str) -> DataFrame:
    """(value): one bulk response per hundred events; error events are failed items."""
    failed = F.col("event_type") == "error"
    error = F.when(failed, F.struct(F.lit("rejected").alias("type"), F.lit("queue full").alias("reason")))
    item = F.struct(
        F.struct(
            F.when(failed, 429).otherwise(F.when(F.col("event_id") % 2 == 0, 201).otherwise(200)).alias("status"),
            error.alias("error"),
        ).alias("index")
    )
    batch = F.floor(F.col("event_id") / 100)  # a batch has at most 100 items
    return table(spark, sf, "events").groupBy(batch.alias("batch")).agg(
        F.max(failed).alias("errors"), F.collect_list(item).alias("items")
    ).select(F.to_json(F.struct("errors", "items")).alias("value"))


# Events land in slices of their time, each sent twice; a row is late by less than this.
LOG_DELAY = "6 hours"
SLICES = 5


def events(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of `events`, times as instants."""
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def land_events(spark: SparkSession, sf: str, times: int) -> Iterator[str]:
    """Land events as NDJSON files in the order of their time, each slice sent `times` times.

    Gives the folder after each slice, so that a stream takes the slice's files
    as one batch, however many tasks wrote them.
    """
    path, slices = session.workspace(spark, "landed-events"), session.workspace(spark, "event-slices")
    rows = events(spark, sf)
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    width = (last - first) // SLICES + 1
    at = F.floor((F.unix_micros("ts") - first) / width)
    rows.withColumn("slice", at).write.partitionBy("slice").parquet(slices)
    landed = spark.read.parquet(slices)
    for k in range(SLICES):
        for _ in range(times):
            landed.where(F.col("slice") == k).drop("slice").write.mode("append").option(
                "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
            ).json(path)
            yield path
