"""Scoring expressions and the weights of the two rankings."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.2
B = 0.75

# Field boosts of the keyword ranking.
BEST_FIELDS = {
    "title": 3.0,
    "title.keyword": 4.0,
    "tagline": 1.5,
    "overview": 1.0,
    "cast.name": 3.0,
    "director": 3.0,
}
CROSS_FIELDS = {"title": 2.0, "overview": 1.0, "cast.name": 3.0}
CROSS_DIRECTOR = 3.0
GENRE_TERM = 4.0
KEYWORD_TERM = 3.0
PHRASES = {"title": 8.0, "cast.name": 6.0}
SLOPPY_PHRASES = {"overview": 2.0}
SLOP = 2

# Signal weights, decay scale in days, values for missing fields.
KEYWORD_SIGNALS = {"popularity": 0.8, "vote_count": 0.4, "vote_average": 0.1, "recency": 0.15}
BROWSE_SIGNALS = {"popularity": 1.5, "vote_count": 0.3, "vote_average": 0.5, "recency": 1.5}
KEYWORD_SCALE = 3650
BROWSE_SCALE = 730
MISSING_POPULARITY = 1.0
MISSING_VOTE_COUNT = 1
MISSING_VOTE_AVERAGE = 5.0


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln(1 + (n_docs - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avg_len: Column) -> Column:
    """BM25 term-frequency part; 1 where the field is exact (no average length)."""
    part = tf / (tf + K1 * ((1 - B) + B * dl / avg_len))
    return F.when(avg_len.isNull(), F.lit(1.0)).otherwise(part)


def scale_factor(avg_len: Column) -> Column:
    return F.when(avg_len.isNull(), F.lit(1.0)).otherwise(F.lit(K1 + 1))


def boost_of(field: Column, boosts: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, b in boosts.items():
        out = F.when(field == name, F.lit(b)).otherwise(out)
    return out


def date_decay(date: Column, as_of: dt.date, scale_days: int) -> Column:
    """Bell curve over the distance in days: 1 at `as_of`, 0.5 at the scale, 1 if no date."""
    days = F.abs(F.datediff(F.lit(as_of), date))
    return F.coalesce(
        F.exp(F.pow(days / F.lit(float(scale_days)), F.lit(2.0)) * F.lit(math.log(0.5))),
        F.lit(1.0),
    )


def signal_parts(as_of: dt.date, weights: dict[str, float], scale_days: int) -> dict[str, Column]:
    """The four weighted signals of a document; logarithms are base 10."""
    pop = F.coalesce(F.col("popularity"), F.lit(MISSING_POPULARITY))
    votes = F.coalesce(F.col("vote_count"), F.lit(MISSING_VOTE_COUNT))
    avg = F.coalesce(F.col("vote_average"), F.lit(MISSING_VOTE_AVERAGE))
    return {
        "popularity": F.lit(weights["popularity"]) * F.log10(1 + pop),
        "vote_count": F.lit(weights["vote_count"]) * F.log10(2 + votes),
        "vote_average": F.lit(weights["vote_average"]) * avg,
        "recency": F.lit(weights["recency"]) * date_decay(F.col("release_dt"), as_of, scale_days),
    }


def signal_sum(as_of: dt.date, weights: dict[str, float], scale_days: int) -> Column:
    p = signal_parts(as_of, weights, scale_days)
    return p["popularity"] + p["vote_count"] + p["vote_average"] + p["recency"]


def keyword_signals(as_of: dt.date) -> Column:
    return signal_sum(as_of, KEYWORD_SIGNALS, KEYWORD_SCALE)


def browse_signals(as_of: dt.date) -> Column:
    return signal_sum(as_of, BROWSE_SIGNALS, BROWSE_SCALE)
