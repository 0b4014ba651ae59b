"""Columns as shown to a reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stars(rating: Column) -> Column:
    """Out of five, halves up."""
    return F.round(rating / 2).cast("int")


def one_decimal(rating: Column) -> Column:
    return F.round(rating, 1)


def runtime_text(minutes: Column) -> Column:
    """`1h 42m`, or `42m` below an hour."""
    hours = F.floor(minutes / 60).cast("int")
    left = F.concat(F.pmod(minutes, F.lit(60)).cast("string"), F.lit("m"))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), left)).otherwise(left)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def image_url(base: str, size: str, path: Column) -> Column:
    """`base/size` followed by the stored path; null without one."""
    return F.when(F.coalesce(F.length(path), F.lit(0)) > 0, F.concat(F.lit(f"{base}/{size}"), path))


def display_columns(image_base: str = "") -> dict[str, Column]:
    """All shown columns by name, over a catalogue row with `release_dt`."""
    shown_rating = F.col("vote_average") > 0
    first_name = F.get(F.col("cast.name"), F.lit(0))
    return {
        "year": F.year("release_dt"),
        "stars": F.when(shown_rating, stars(F.col("vote_average"))),
        "rating": F.when(shown_rating, one_decimal(F.col("vote_average"))),
        "runtime_text": runtime_text(F.col("runtime")),
        "language": F.upper("original_language"),
        "card_genres": F.slice("genres", 1, 2),
        "shown_keywords": F.slice("keywords", 1, 10),
        "cast_initial": F.left(first_name, F.lit(1)),
        "votes_text": thousands(F.col("vote_count")),
        "card_image": image_url(image_base, "w342", F.col("poster_path")),
        "detail_image": image_url(image_base, "w500", F.col("poster_path")),
        "wide_image": image_url(image_base, "w1280", F.col("backdrop_path")),
    }
