"""Suffix stripping for English (Porter 1980) as SQL expressions.

A word is read as [C](VC)^m[V], runs of consonants and vowels. Each rule is a
pattern that holds the measure condition on the stem and the suffix at once,
so the whole stemmer is a chain of regular-expression steps over a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = "[^aeiou][^aeiouy]*"
V = "[aeiouy][aeiou]*"
VOWEL_IN_STEM = f"(?:{C})?[aeiouy]"
M_OVER_0 = f"(?:{C})?{V}{C}"
M_OVER_1 = f"(?:{C})?{V}{C}{V}{C}"
M_IS_1 = f"(?:{C})?{V}{C}(?:{V})?"
SHORT_STEM = f"{C}[aeiouy][^aeiouwxy]"

# Suffix rules of steps 2 to 4, as published with the later
# amendments bli and logi. In each step the longest suffix that fits decides.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("logi", "log"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def longest_first(rules):
    return sorted(rules, key=lambda r: -len(r[0]))


def step_4_rules():
    """Suffix and the extra stem condition: ion needs s or t before it."""
    return longest_first([(s, "[st]" if s == "ion" else "") for s in STEP_4])


def _suffix_step(word: Column, rules, measure: str) -> Column:
    out = word
    for suffix, repl in reversed(longest_first(rules)):
        done = F.regexp_replace(word, F.lit(f"^({measure}.*){suffix}$"), F.lit(f"$1{repl}"))
        out = F.when(word.endswith(suffix), done).otherwise(out)
    return out


def _step_4(word: Column) -> Column:
    out = word
    for suffix, before in reversed(step_4_rules()):
        # the letter before the suffix counts towards the measure of the stem
        stem = F.left(word, F.length(word) - len(suffix))
        ok = stem.rlike(f"^{M_OVER_1}") & stem.rlike(f"{before}$")
        out = F.when(word.endswith(suffix), F.when(ok, stem).otherwise(word)).otherwise(out)
    return out


def with_stems(vocab: DataFrame, term: str = "term", stem: str = "stem") -> DataFrame:
    """Add the stem of each term; meant for distinct terms, not for occurrences."""
    w, b = F.col("_w"), F.col("_b")
    df = vocab.withColumn("_w", F.regexp_replace(term, "^y", "Y"))
    df = df.withColumn(
        "_w",
        F.when(w.endswith("sses") | w.endswith("ies"), F.left(w, F.length(w) - 2))
        .when(w.endswith("ss"), w)
        .when(w.endswith("s"), F.left(w, F.length(w) - 1))
        .otherwise(w),
    )
    df = df.withColumn(
        "_b",
        F.when(
            w.endswith("eed"), F.regexp_replace(w, F.lit(f"^({M_OVER_0}.*)eed$"), F.lit("$1ee"))
        ).otherwise(F.regexp_replace(w, F.lit(f"^({VOWEL_IN_STEM}.*)(?:ed|ing)$"), F.lit("$1"))),
    )
    last = F.right(b, F.lit(1))
    doubled = (last == F.substring(b, -2, 1)) & (F.length(b) > 1) & b.rlike("[^aeiouylsz]$")
    df = df.withColumn(
        "_w",
        F.when(w.endswith("eed") | (b == w), b)
        .when(b.rlike("(?:at|bl|iz)$"), F.concat(b, F.lit("e")))
        .when(doubled, F.left(b, F.length(b) - 1))
        .when(b.rlike(f"^{SHORT_STEM}$"), F.concat(b, F.lit("e")))
        .otherwise(b),
    )
    df = df.withColumn(
        "_w", F.regexp_replace(w, F.lit(f"^({VOWEL_IN_STEM}.*)y$"), F.lit("$1i"))
    )
    df = df.withColumn("_w", _suffix_step(w, STEP_2, M_OVER_0))
    df = df.withColumn("_w", _suffix_step(w, STEP_3, M_OVER_0))
    df = df.withColumn("_w", _step_4(w))
    less = F.left(w, F.length(w) - 1)
    drop_e = w.endswith("e") & (
        less.rlike(f"^{M_OVER_1}") | (less.rlike(f"^{M_IS_1}$") & ~less.rlike(f"^{SHORT_STEM}$"))
    )
    df = df.withColumn("_w", F.when(drop_e, less).otherwise(w))
    df = df.withColumn("_w", F.when(w.endswith("ll") & w.rlike(f"^{M_OVER_1}"), less).otherwise(w))
    return df.withColumn(
        stem, F.when(F.length(term) <= 2, F.col(term)).otherwise(F.regexp_replace("_w", "^Y", "y"))
    ).drop("_w", "_b")
