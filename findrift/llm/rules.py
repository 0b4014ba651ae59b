"""Quality rules as a ledger of failure bits; policies and ablations read bits only.

`ledger` measures each text once and stores one bit per rule with the
measurements. A policy is a mask over those bits with a version: keeping,
rejecting and the question which rule alone rejects what are bitwise operations
on the ledger, never a second look at a text. DataFrame functions only; a
document's words stay in its row, so there is no shuffle.

A word is a run of characters outside space and 0x09-0x0D. Null text has no
words. Rows with a null or repeated id are measured like all others, and columns
of the input are carried only where asked for. An empty table gives an empty
ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5

# Names of the bits, in order; a name never changes its bit.
RULES = (
    "few_words",
    "repeated_words",
    "symbols",
    "duplicate_lines",
    "upper_case",
    "long_words",
    "few_letters",
)


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1, RULES)
PRODUCTION = Policy(
    "production", 1, ("few_words", "repeated_words", "symbols", "duplicate_lines", "upper_case", "long_words")
)


def _chars(text: Column, kept: str) -> Column:
    """How many characters are in a class."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("bigint")


def _rows(docs: DataFrame, carry: list[str], text_col: str) -> DataFrame:
    """One working row per document: `_r` holds the carried columns, so no name can clash."""
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    return docs.select(
        kept.alias("_r"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t")
    )


def _repeats(d: DataFrame) -> DataFrame:
    """Adds _rep: words inside windows of five found twice or more in the text."""
    at = lambda i, j: F.get(F.col("_h"), i + F.lit(j))
    grams = F.transform(
        F.sequence(F.lit(0), F.size("_h") - WINDOW),
        lambda i: F.xxhash64(*[at(i, j) for j in range(WINDOW)]),
    )
    none = F.array().cast("array<bigint>")
    d = d.withColumn("_g", F.when(F.size("_h") >= WINDOW, grams).otherwise(none))
    placed = F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    d = d.withColumn(
        "_s",
        F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(placed)).otherwise(
            F.array().cast("array<struct<g:bigint,i:int>>")
        ),
    ).drop("_g")
    beside = lambda s, k, by: F.coalesce(F.get(F.col("_s"), k + F.lit(by))["g"] == s["g"], F.lit(False))
    twice = F.filter("_s", lambda s, k: beside(s, k, -1) | beside(s, k, 1))
    starts = F.sort_array(F.transform(twice, lambda s: s["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        starts,
        zero,
        lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")
        ),
        lambda a: a["n"].cast("bigint"),
    )
    return d.withColumn("_rep", covered).drop("_s", "_h")


def ledger(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """`carry` columns, the measurements, and `failed`: bit k is set where RULES[k] fails."""
    carry = [c for c in docs.columns if c != text_col] if carry is None else carry
    d = _rows(docs, carry, text_col)
    d = d.withColumn("_w", F.split(F.btrim(F.col("_t"), F.lit(BLANKS)), "[ \\t-\\r]+"))
    d = d.withColumn("_w", F.when(F.col("_w")[0] == "", F.array().cast("array<string>")).otherwise(F.col("_w")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    d = d.withColumn("_l", lines)
    d = d.select(
        "_r",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        _chars(F.col("_t"), "#*$%&|<>").alias("n_symbols"),
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        _chars(F.col("_t"), "\\p{Lu}").alias("n_upper"),
        _chars(F.col("_t"), "\\p{L}").alias("n_letters"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    d = _repeats(d).withColumnRenamed("_rep", "n_repeat_words")
    n, chars = F.col("n_words"), F.col("word_chars")
    fails = {
        "few_words": n < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 100 * F.col("n_symbols") > 4 * chars,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "upper_case": 100 * F.col("n_upper") > 50 * F.col("n_letters"),
        "long_words": chars > 20 * n,
        "few_letters": 100 * F.col("n_letters") < 60 * chars,
    }
    bits = [F.when(fails[r], F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    # A filter on the ledger must stay above it: pushed down, it would measure a text
    # again for each measurement it names. Nothing is pushed past this expression.
    failed = failed.bitwiseOR(F.when(F.monotonically_increasing_id() < 0, F.lit(1)).otherwise(F.lit(0)))
    numbers = (
        "n_words word_chars n_symbols n_lines n_dup_lines n_upper n_letters n_repeat_words".split()
    )
    taken = [c for c in numbers + ["failed"] if c in carry]
    if taken:
        raise ValueError(f"carried columns share names with measurements: {taken}")
    return d.select(*[F.col("_r")[c].alias(c) for c in carry], *numbers, failed.cast("bigint").alias("failed"))


def fails(policy: Policy, failed: Column | str = "failed") -> Column:
    """True where a document breaks a rule of the policy."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(policy.mask)) != 0


def ablations(book: DataFrame, policies: list[Policy]) -> DataFrame:
    """(policy, version, rule, rejected, only_this): what a rule rejects, and what it alone rejects.

    One count per pattern of failure bits comes first (at most 2 to the number
    of rules rows); everything else reads those counts.
    """
    spark = book.sparkSession
    patterns = book.groupBy("failed").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame(
        [(p.name, p.version, r, p.mask, 1 << RULES.index(r)) for p in policies for r in p.rules],
        "policy string, version int, rule string, mask bigint, bit bigint",
    )
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit")
    return (
        asked.join(F.broadcast(patterns), hit, "left")
        .groupBy("policy", "version", "rule")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rejected"),
            F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).cast("bigint").alias("only_this"),
        )
    )


def keep(docs: DataFrame, policy: Policy = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The documents that pass, with their columns as they were."""
    names = docs.columns
    book = ledger(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(f"`{text_col}`").alias("_txt")),
                  ["_doc"], "_txt")
    return book.where(~fails(policy)).select("_doc.*")
