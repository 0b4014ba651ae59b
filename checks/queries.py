"""Every operator over the supplied tables, in the columns of `spec`."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import bindings as B
from checks.spec import columns
from findrift import schemas, session
from findrift.functions import scoring as S
from findrift.functions.display import display_columns
from findrift.operators import analysis as A
from findrift.operators import facets as FC
from findrift.operators import filters as FL
from findrift.operators import index as IX
from findrift.operators import logs as L
from findrift.operators import lookup as LK
from findrift.operators import matching as M
from findrift.operators import requests as R
from findrift.operators import similar as SM
from findrift.operators.fuzzy import fuzzy_expand
from findrift.plans import search as SE
from findrift.plans.catalog_load import load_catalog
from findrift.sources import bulk as BK
from findrift.sources import details as D
from findrift.sources import exports as X
from findrift.sources import tables as TB
from findrift.streaming import streams as ST

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def shaped(df: DataFrame, name: str) -> DataFrame:
    """The columns of the spec, in their compared form."""
    out = []
    for col, kind in columns(name):
        c = F.col(f"`{col}`")
        form = {
            "i": lambda c=c: c.cast("bigint"),
            "s": lambda c=c: c.cast("string"),
            "f": lambda c=c: F.round(c.cast("double"), 6),
            "b": lambda c=c: c.cast("boolean"),
            "l": lambda c=c: F.array_join(c.cast("array<string>"), ","),
            "t": lambda c=c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        }[kind]
        out.append(form().alias(col))
    return df.select(*out)


def register(fn):
    """Register a function under its own name, less a trailing underscore."""
    name = fn.__name__.rstrip("_")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return shaped(fn(spark, sf), name)

    _REGISTRY[name] = run
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTRY)


# --- text analysis ---------------------------------------------------------


@register
def tokens_standard(spark, sf):
    return A.standard_tokens(B.catalog(spark, sf))


@register
def tokens_english(spark, sf):
    return A.english_tokens(B.catalog(spark, sf))


@register
def edge_ngrams(spark, sf):
    return A.title_grams(B.catalog(spark, sf))


@register
def autocomplete(spark, sf):
    return LK.autocomplete(B.index(spark, sf), B.keyword_queries(spark, sf), 10)


@register
def field_variants(spark, sf):
    return A.field_variants(B.catalog(spark, sf))


@register
def cast_positions(spark, sf):
    return A.cast_positions(B.catalog(spark, sf))


@register
def build_postings(spark, sf):
    return IX.postings(IX.by_id(B.catalog(spark, sf)))


@register
def vocab_stats(spark, sf):
    return IX.vocab(IX.postings(IX.by_id(B.catalog(spark, sf))))


@register
def field_stats(spark, sf):
    return IX.field_stats(IX.postings(IX.by_id(B.catalog(spark, sf))))


# --- ranked retrieval ------------------------------------------------------


@register
def bm25_match(spark, sf):
    return M.bm25_match(B.index(spark, sf), B.keyword_queries(spark, sf))


@register
def best_fields(spark, sf):
    return M.best_fields(B.index(spark, sf), B.keyword_queries(spark, sf))


@register
def fuzzy_expand_(spark, sf):
    return fuzzy_expand(
        B.index(spark, sf), M.fuzzy_terms(B.keyword_queries(spark, sf)).select("field", "qterm")
    )


@register
def cross_fields(spark, sf):
    return M.cross_fields(B.index(spark, sf), B.keyword_queries(spark, sf))


@register
def term_match(spark, sf):
    return M.term_match(B.index(spark, sf), B.keyword_queries(spark, sf))


@register
def phrase_match(spark, sf):
    return M.phrase_match(B.index(spark, sf), B.keyword_queries(spark, sf))


@register
def phrase_slop(spark, sf):
    return M.phrase_slop(B.index(spark, sf), B.keyword_queries(spark, sf))


@register
def bool_should(spark, sf):
    return M.bool_should(B.index(spark, sf), B.keyword_queries(spark, sf))


@register
def signal_scores(spark, sf):
    parts = S.signal_parts(B.AS_OF, S.KEYWORD_SIGNALS, S.KEYWORD_SCALE)
    return IX.index_docs(B.catalog(spark, sf)).select(
        "id", parts["popularity"].alias("popularity"), parts["vote_count"].alias("vote_count"),
        parts["vote_average"].alias("vote_average"),
        S.keyword_signals(B.AS_OF).alias("keyword_sum"),
        S.browse_signals(B.AS_OF).alias("browse_sum"),
    )


@register
def date_decay(spark, sf):
    date = F.col("release_dt")
    return IX.index_docs(B.catalog(spark, sf)).select(
        "id", "release_date",
        S.date_decay(date, B.AS_OF, S.KEYWORD_SCALE).alias("keyword_decay"),
        S.date_decay(date, B.AS_OF, S.BROWSE_SCALE).alias("browse_decay"),
    )


@register
def browse(spark, sf):
    return SE.browse(IX.index_docs(B.catalog(spark, sf)), B.AS_OF, R.DEFAULT_PAGE_SIZE)


def _search(spark, sf) -> SE.Search:
    return SE.search(B.index(spark, sf), B.requests(spark, sf), B.AS_OF)


@register
def search(spark, sf):
    return _search(spark, sf).hits("title", "genres", "vote_average", "release_date", "director")


@register
def search_page(spark, sf):
    return _search(spark, sf).hits()


@register
def search_cumulative(spark, sf):
    return _search(spark, sf).hits(cumulative=True)


@register
def search_totals(spark, sf):
    return _search(spark, sf).totals()


@register
def facet_genres(spark, sf):
    return _search(spark, sf).facets()


@register
def similar_docs(spark, sf):
    return SM.similar_docs(
        B.index(spark, sf), B.similar_requests(spark, sf), "title", "genres", "vote_average", "release_date"
    )


# --- filters, lookups, facets ----------------------------------------------


def _matches(spark, sf) -> DataFrame:
    """Text matches with the request's filters and the document's filtered fields."""
    ix = B.index(spark, sf)
    docs = ix.docs.select("id", F.col("genres").alias("doc_genres"), "vote_average")
    wanted = B.requests(spark, sf).select("query_id", "genres", "rating_min", "rating_max")
    wanted = session.stash(wanted, "filters")
    return M.bool_should(ix, B.keyword_queries(spark, sf), docs=docs).join(session.beside(wanted), "query_id")


@register
def filter_genres_any(spark, sf):
    return _matches(spark, sf).where(FL.any_genre(F.col("doc_genres"), F.col("genres")))


@register
def filter_rating_range(spark, sf):
    return _matches(spark, sf).where(
        FL.rating_between(F.col("vote_average"), F.col("rating_min"), F.col("rating_max"))
    )


@register
def post_filter(spark, sf):
    return _matches(spark, sf).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(FL.post_filter()).alias("kept")
    )


@register
def genres_overview(spark, sf):
    return FC.genres_overview(B.catalog(spark, sf))


@register
def lookup_by_id(spark, sf):
    ids = B.id_requests(spark, sf).select("query_id", F.col("anchor").alias("id"))
    return LK.lookup_by_id(ids, B.catalog(spark, sf), "title", "director")


@register
def source_excludes(spark, sf):
    left_overs = B.catalog(spark, sf).withColumn("model_id", F.lit("m"))
    return FL.source_excludes(left_overs, "model_id", "elser_error")


@register
def normalize_requests(spark, sf):
    return R.normalize_requests(B.raw_requests(spark, sf))


@register
def normalize_limits(spark, sf):
    return R.normalize_limits(B.raw_limits(spark, sf))


@register
def display_columns_(spark, sf):
    docs = IX.index_docs(B.catalog(spark, sf)).withColumn(
        "poster_path", F.concat(F.lit("/"), F.col("id").cast("string"), F.lit(".jpg"))
    ).withColumn("backdrop_path", F.lit(""))
    shown = [c.alias(n) for n, c in display_columns("images").items()]
    return docs.select("id", *shown)


@register
def parse_release_date(spark, sf):
    return IX.index_docs(B.catalog(spark, sf))


# --- sources and sinks -----------------------------------------------------


@register
def id_export_scan(spark, sf):
    path = session.workspace(spark, "export")
    B.id_export(spark, sf).write.option("compression", "gzip").json(path)
    return X.id_export_scan(spark, path)


@register
def latest_snapshot(spark, sf):
    return X.latest_snapshot(spark, B.write_exports(spark, sf), B.AS_OF)


@register
def top_popular_ids(spark, sf):
    return X.top_popular_ids(B.id_export(spark, sf))


@register
def detail_scan(spark, sf):
    raw = D.detail_scan(spark, B.write_details(spark, sf))
    return raw.select(
        "id", "title", F.size("genres").alias("n_genres"), F.size("credits.cast").alias("n_cast"),
        F.size("credits.crew").alias("n_crew"), "status_code",
        F.col("_corrupt_record").isNotNull().alias("malformed"),
    )


def _accepted(spark, sf) -> DataFrame:
    return D.accepted(D.detail_scan(spark, B.write_details(spark, sf)))


@register
def normalize_detail(spark, sf):
    return D.normalize_detail(_accepted(spark, sf)).withColumn("cast_names", F.col("cast.name"))


@register
def array_pluck(spark, sf):
    return _accepted(spark, sf).select(
        "id", D.array_pluck(F.col("genres"), "name").alias("genres"),
        D.array_pluck(F.col("keywords.keywords"), "name").alias("keywords"),
    )


@register
def array_first_k(spark, sf):
    top = _accepted(spark, sf).select(
        "id", F.posexplode(D.top_cast(F.col("credits.cast"))).alias("position", "member")
    )
    return top.select("id", "position", "member.*")


@register
def first_match(spark, sf):
    return _accepted(spark, sf).select("id", D.director(F.col("credits.crew")).alias("director"))


@register
def reject_error_docs(spark, sf):
    return D.rejected(D.detail_scan(spark, B.write_details(spark, sf)))


@register
def ids_join_detail(spark, sf):
    ids = X.top_popular_ids(B.id_export(spark, sf))
    usable = _accepted(spark, sf)
    loaded = D.ids_join_detail(ids, usable).select("id", F.lit(True).alias("loaded"), "title")
    skipped = D.skipped_ids(ids, usable).select(
        "id", F.lit(False).alias("loaded"), F.lit(None).cast("string").alias("title")
    )
    return loaded.unionByName(skipped)


def _load(spark, sf):
    out = session.workspace(spark, "catalog")
    return load_catalog(spark, B.write_exports(spark, sf), B.write_details(spark, sf), out, B.AS_OF)


@register
def catalog_refresh(spark, sf):
    return _load(spark, sf).catalog


@register
def load_tallies(spark, sf):
    return _load(spark, sf).tallies


@register
def upsert_by_id(spark, sf):
    base = B.catalog(spark, sf).select("id", "title", "director")
    return TB.upsert_by_id(base, B.delta(spark, sf))


@register
def append_generated_id(spark, sf):
    # two batches that arrive in the same moments, and once more with all rows in one millisecond
    rows = B.events(spark, sf).select("event_id", F.date_trunc("hour", "ts").alias("arrived"))
    burst = B.events(spark, sf).select(
        (F.col("event_id") + 1_000_000_000).alias("event_id"), F.lit(0).cast("timestamp").alias("arrived")
    )
    batches = [rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), burst]
    return reduce(
        DataFrame.unionByName, [TB.with_generated_ids(b, "arrived", "event_id") for b in batches]
    )


def _bulk_docs(spark, sf) -> DataFrame:
    """Documents whose first key reads like an action."""
    return B.catalog(spark, sf).select(
        "id", F.struct(F.col("id").alias("_id")).alias("index"), "title", "overview", "genres",
        "vote_count", "popularity",
    )


@register
def bulk_pairs_sink(spark, sf):
    path = session.workspace(spark, "bulk")
    BK.write_bulk_pairs(_bulk_docs(spark, sf).select("id", "title", "genres", "vote_count"), path, index="catalog", id_column="id")
    return spark.read.text(path)


@register
def bulk_auto_ids(spark, sf):
    """Log rows as bulk files without ids, which the reader of the files assigns."""
    path = session.workspace(spark, "bulk")
    BK.write_bulk_pairs(B.events(spark, sf).select("event_id", "user_id", "event_type"), path)
    return spark.read.text(path)


@register
def bulk_pairs_scan(spark, sf):
    path = session.workspace(spark, "bulk")
    BK.write_bulk_pairs(_bulk_docs(spark, sf), path, id_column="id")
    schema = "title STRING, overview STRING, genres ARRAY<STRING>, vote_count INT, popularity DOUBLE"
    return BK.bulk_pairs_scan(spark, path, schema).withColumnRenamed("_id", "id")


@register
def bulk_outcome(spark, sf):
    return BK.bulk_outcome(B.bulk_responses(spark, sf))


@register
def table_count(spark, sf):
    return TB.table_count(B.catalog(spark, sf), "catalog").unionByName(
        TB.table_count(B.table(spark, sf, "events"), "events")
    )


# --- logs ------------------------------------------------------------------


@register
def log_append(spark, sf):
    path = session.workspace(spark, "logs")
    rows = B.events(spark, sf)
    TB.append_by_day(rows, path, "ts")
    TB.append_by_day(rows, path, "ts")
    return TB.stored_or_empty(spark, path, schemas.EVENT + ", dt DATE")


@register
def log_postings(spark, sf):
    return L.log_postings(B.table(spark, sf, "conversations"), ["conv_id", "turn"], ["role", "text"])


# --- streams ---------------------------------------------------------------


@register
def stream_log_append(spark, sf):
    out, state = session.workspace(spark, "stream-logs"), session.workspace(spark, "stream-state")
    for path in B.land_events(spark, sf, 1):
        rows = ST.read_logs(spark, path, schemas.EVENT)
        ST.append_logs(rows, "ts", out, state, drain=True).awaitTermination()
    return TB.stored_or_empty(spark, out, schemas.EVENT + ", dt DATE")


@register
def stream_dedupe(spark, sf):
    out, state = session.workspace(spark, "stream-once"), session.workspace(spark, "stream-state")
    for path in B.land_events(spark, sf, 2):
        landed = ST.read_logs(spark, path, schemas.EVENT)
        rows = ST.once_per_key(landed, "event_id", "ts", B.LOG_DELAY)
        ST.append_logs(rows, "ts", out, state, drain=True).awaitTermination()
    return TB.stored_or_empty(spark, out, schemas.EVENT + ", dt DATE")


@register
def stream_upsert(spark, sf):
    landed = session.workspace(spark, "landed-delta")
    delta = B.delta(spark, sf)
    for version in (1, 2):
        delta.where(F.col("seq") == version).write.mode("append").json(landed)
    arrivals = (
        spark.readStream.schema("id BIGINT, title STRING, director STRING, seq INT")
        .option("maxFilesPerTrigger", 2).json(landed)
    )
    deltas = session.workspace(spark, "deltas")
    state = session.workspace(spark, "stream-state")
    ST.upsert_arrivals(arrivals, deltas, state, drain=True).awaitTermination()
    return ST.current(B.catalog(spark, sf).select("id", "title", "director"), deltas)
