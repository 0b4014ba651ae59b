"""Text analysis expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"

MIN_GRAM = 2
MAX_GRAM = 15

# The English stop list of 33 words.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is",
    "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there",
    "these", "they", "this", "to", "was", "will", "with",
)


def words(text: Column) -> Column:
    """Lower-cased words in order; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def strip_possessive(text: Column) -> Column:
    """Remove 's at the end of words."""
    pat = r"([\p{L}\p{N}])['’][sS]($|[^\p{L}\p{N}])"
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(pat), F.lit("$1$2"))


def edge_grams(word: Column) -> Column:
    """Prefixes of length 2 to 15; none for a shorter word."""
    n = F.least(F.lit(MAX_GRAM), F.length(word))
    return F.when(
        F.length(word) >= MIN_GRAM,
        F.transform(F.sequence(F.lit(MIN_GRAM), n), lambda k: F.substring(word, F.lit(1), k)),
    ).otherwise(F.array().cast("array<string>"))
