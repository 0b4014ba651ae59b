"""Landed raw detail records and their projection to catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift import schemas

CAST_SIZE = 10
DIRECTOR = "Director"


def detail_scan(spark: SparkSession, path: str) -> DataFrame:
    """Typed raw records; a record of another shape keeps its text in `_corrupt_record`.

    Lines are parsed with explicit options, which keeps the whole schema in the
    parse. A pruned read would judge a record by the selected columns only, so
    the same record could be fine in one query and malformed in the next.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    record = F.from_json("value", schemas.DETAIL + ", _corrupt_record STRING", options)
    return spark.read.text(path).select(record.alias("r")).select("r.*")


def _reason() -> Column:
    return F.when(F.col("_corrupt_record").isNotNull(), "malformed").when(
        F.coalesce("status_code", F.lit(0)) != 0, "error document"
    )


def accepted(details: DataFrame) -> DataFrame:
    """Records that can be projected."""
    return details.where(_reason().isNull()).drop("_corrupt_record", "status_code")


def rejected(details: DataFrame) -> DataFrame:
    """(id, reason, status_code) of the records left out."""
    return details.where(_reason().isNotNull()).select(
        "id", _reason().alias("reason"), "status_code"
    )


def ids_join_detail(ids: DataFrame, details: DataFrame) -> DataFrame:
    """Details of the wanted ids; ids without a usable record are dropped."""
    return ids.select("id").join(details, "id")


def skipped_ids(ids: DataFrame, details: DataFrame) -> DataFrame:
    return ids.select("id").join(details.select("id"), "id", "left_anti")


def array_pluck(structs: Column, name: str) -> Column:
    """One field of every element; an absent array is empty."""
    return F.coalesce(structs[name], F.array().cast("array<string>"))


def array_first_k(structs: Column, k: int) -> Column:
    """The first k elements in source order; an absent array is empty."""
    return F.slice(structs, 1, k)


def first_match(structs: Column, test, name: str, default: str = "") -> Column:
    """A field of the first element that passes `test`, else the default."""
    return F.coalesce(F.get(F.filter(structs, test), F.lit(0))[name], F.lit(default))


def top_cast(cast: Column) -> Column:
    """The first ten cast members with their defaults filled in."""
    member = F.transform(
        array_first_k(cast, CAST_SIZE),
        lambda c: F.struct(
            c["name"].alias("name"),
            F.coalesce(c["character"], F.lit("")).alias("character"),
            F.coalesce(c["order"], F.lit(0)).cast("bigint").alias("order"),
            F.coalesce(c["profile_path"], F.lit("")).alias("profile_path"),
        ),
    )
    empty = F.array().cast(
        "array<struct<name:string,character:string,order:bigint,profile_path:string>>"
    )
    return F.coalesce(member, empty)


def director(crew: Column) -> Column:
    return first_match(crew, lambda c: c["job"] == DIRECTOR, "name")


def normalize_detail(details: DataFrame) -> DataFrame:
    """Raw record to catalogue row; a missing or null value becomes its default."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")).alias(c)

    def number(c: str, kind: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)

    return details.select(
        F.col("id").cast("string").alias("id"),
        text("title"), text("overview"), text("release_date"),
        number("vote_average", "double"), number("vote_count", "int"),
        number("popularity", "double"),
        array_pluck(F.col("genres"), "name").alias("genres"),
        number("runtime", "int"), number("budget", "bigint"), number("revenue", "bigint"),
        text("poster_path"), text("backdrop_path"), text("original_language"), text("tagline"),
        array_pluck(F.col("keywords.keywords"), "name").alias("keywords"),
        top_cast(F.col("credits.cast")).alias("cast"),
        director(F.col("credits.crew")).alias("director"),
    )
