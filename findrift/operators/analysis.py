"""Turning catalogue fields into terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findrift import session
from findrift.functions import text as T
from findrift.functions.stemmer import with_stems

# Position distance between two values of a multi-valued field, so that a
# phrase cannot run from one value into the next.
VALUE_GAP = 100

ANALYSED = ("title", "tagline", "overview", "cast.name")
EXACT = ("title.keyword", "director", "genres", "keywords")


def _one(value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))


def _values(value: Column) -> Column:
    return F.coalesce(F.array_distinct(value), F.array().cast("array<string>"))


def _entry(name: str, terms: Column, exact: bool, owner: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("field"),
        F.lit(exact).alias("exact"),
        terms.alias("terms"),
        (F.lit(None).cast("array<int>") if owner is None else owner).alias("owner"),
    )


def field_terms(docs: DataFrame) -> DataFrame:
    """One row per document and field: (id, field, exact, terms, owner).

    `owner` is the index of the value a term came from, kept only for
    multi-valued analysed fields.
    """
    names = F.coalesce(F.col("cast.name"), F.array().cast("array<string>"))
    cast_terms = F.flatten(F.transform(names, lambda n: T.words(n)))
    cast_owner = F.flatten(
        F.transform(names, lambda n, i: F.array_repeat(i, F.size(T.words(n)).cast("int")))
    )
    entries = F.array(
        _entry("title", T.words(F.col("title")), False),
        _entry("tagline", T.words(F.col("tagline")), False),
        _entry("overview", T.words(F.col("overview")), False),
        _entry("cast.name", cast_terms, False, cast_owner),
        _entry("title.keyword", _one(F.col("title")), True),
        _entry("director", _one(F.col("director")), True),
        _entry("genres", _values(F.col("genres")), True),
        _entry("keywords", _values(F.col("keywords")), True),
    )
    return docs.select("id", F.explode(entries).alias("e")).select("id", "e.*")


def tokens(docs: DataFrame) -> DataFrame:
    """One row per term occurrence: (id, field, exact, dl, pos, term).

    Exact fields have no positions and a length of 1.
    """
    return (
        field_terms(docs)
        .select(
            "id", "field", "exact", "owner",
            F.when(F.col("exact"), F.lit(1)).otherwise(F.size("terms")).alias("dl"),
            F.posexplode("terms").alias("ord", "term"),
        )
        .select(
            "id", "field", "exact", "dl",
            F.when(
                ~F.col("exact"),
                F.col("ord") + VALUE_GAP * F.coalesce(F.get("owner", F.col("ord")), F.lit(0)),
            ).alias("pos"),
            "term",
        )
    )


def standard_tokens(docs: DataFrame) -> DataFrame:
    """Word split and lower-casing over the analysed fields, positions kept."""
    return tokens(docs).where(~F.col("exact")).select("id", "field", "pos", "term")


def cast_positions(docs: DataFrame) -> DataFrame:
    """Terms of the names in `cast` as one field with gaps between people."""
    return tokens(docs).where(F.col("field") == "cast.name").select("id", "pos", "term")


def field_variants(docs: DataFrame) -> DataFrame:
    """One source value under each of its analysed, exact and prefix names."""
    kinds = (
        ("title", "english", "title"),
        ("title.keyword", "exact", "title"),
        ("title.raw", "standard", "title"),
        ("title.autocomplete", "prefix", "title"),
        ("tagline", "english", "tagline"),
        ("overview", "english", "overview"),
    )
    whole = [
        F.struct(F.lit(f).alias("field"), F.lit(a).alias("analysis"), F.col(c).alias("value"))
        for f, a, c in kinds
    ]

    def each(col: Column, field: str, analysis: str) -> Column:
        return F.transform(
            F.coalesce(col, F.array().cast("array<string>")),
            lambda v: F.struct(
                F.lit(field).alias("field"), F.lit(analysis).alias("analysis"), v.alias("value")
            ),
        )

    keywords, names = F.col("keywords"), F.col("cast.name")
    rows = F.concat(
        F.array(*whole),
        each(keywords, "keywords", "exact"),
        each(keywords, "keywords.text", "english"),
        each(names, "cast.name", "standard"),
        each(names, "cast.name.keyword", "exact"),
    )
    return docs.select("id", F.explode(rows).alias("v")).select("id", "v.*")


def title_grams(docs: DataFrame) -> DataFrame:
    """Prefixes of title words: (id, pos, word, gram)."""
    return docs.select("id", F.posexplode(T.words(F.col("title"))).alias("pos", "word")).select(
        "id", "pos", "word", F.explode(T.edge_grams(F.col("word"))).alias("gram")
    )


def _english_values(docs: DataFrame) -> DataFrame:
    fields = [
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))
        for f in ("title", "tagline", "overview")
    ]
    return docs.select("id", F.explode(F.array(*fields)).alias("v")).select("id", "v.*")


def content_tokens(docs: DataFrame) -> DataFrame:
    """English words without possessive endings and stop words; gaps stay in `pos`."""
    return (
        _english_values(docs)
        .select("id", "field", F.posexplode(T.words(T.strip_possessive(F.col("value")))).alias("pos", "term"))
        .where(~F.col("term").isin(*T.STOP_WORDS))
    )


def english_tokens(docs: DataFrame) -> DataFrame:
    """Stemmed content words: (id, field, pos, term, stem).

    Only distinct words are stemmed; the stems are joined back.
    """
    words = content_tokens(docs)
    # stemming is work per word, so the few distinct words are given to all tasks
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = words.select("term").distinct().repartition(tasks, "term")
    stems = session.stash(with_stems(vocabulary), "stems")
    return words.join(stems, "term").select(
        "id", "field", "pos", "term", "stem"
    )
