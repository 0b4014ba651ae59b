"""Normalising the request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PAGE = 1
DEFAULT_PAGE_SIZE = 24
MAX_PAGE_SIZE = 50
LAST_PAGE = 10**15  # times a page size this still is a bigint
DEFAULT_SIMILAR = 8
MAX_SIMILAR = 20


def _number(text: Column) -> Column:
    """The leading decimal number of a text, or null."""
    lead = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return lead.try_cast("double")


def _integer(text: Column, low: int, high: int) -> Column:
    """The leading whole number of a text within bounds, or null.

    Parsed wide and bounded before it is made whole, so that a number of any
    length ends at a bound.
    """
    wide = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("double")
    # greatest and least skip nulls, hence the test
    return F.when(wide.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), wide))).cast("bigint")


def _bounded(text: Column, default: int, high: int) -> Column:
    """1 to `high`, the default where there is no number."""
    return F.coalesce(_integer(text, 1, high), F.lit(default).cast("bigint"))


def normalize_requests(raw: DataFrame) -> DataFrame:
    """Typed, clamped search requests from text parameters.

    Empty genre items are dropped and an empty list means no filter; numbers
    that do not parse are unset; the page is at least 1 (default 1) and the
    page size 1 to 50 (default 24).
    """
    genres = F.filter(F.split("genres", ","), lambda g: g != "")
    return raw.select(
        "query_id",
        F.coalesce("q", F.lit("")).alias("query"),
        F.when(F.size(genres) > 0, genres).alias("genres"),
        _number(F.col("ratingMin")).alias("rating_min"),
        _number(F.col("ratingMax")).alias("rating_max"),
        _bounded(F.col("page"), DEFAULT_PAGE, LAST_PAGE).alias("page"),
        _bounded(F.col("pageSize"), DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE).cast("int").alias("page_size"),
    )


def normalize_limits(raw: DataFrame) -> DataFrame:
    """Result count of a similarity request: 1 to 20, 8 if absent."""
    return raw.withColumn(
        "limit",
        _bounded(F.col("limit"), DEFAULT_SIMILAR, MAX_SIMILAR).cast("int"),
    )
