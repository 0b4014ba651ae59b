"""Scoring documents against a table of queries.

Every clause without word order is linear in the postings, so all of them
reduce to one small table of coefficients, (query, clause, slot, field, term,
coef, avg_len), and one pass over the postings:

    contribution = coef * saturation(tf, dl, avg_len)

`queries` is always (query_id, query). The postings lie by document id, so the
join with the broadcast coefficients and the aggregations need no shuffle.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findrift import session
from findrift.functions import scoring as S
from findrift.functions import text as T
from findrift.operators.analysis import ANALYSED, EXACT
from findrift.operators.fuzzy import fuzzy_expand
from findrift.operators.index import CUT, Index, with_range
from findrift.operators.scorer import score_documents

# Clause numbers in the coefficient table.
BEST, CROSS, CROSS_EXACT, TERM = 1, 2, 3, 4

# Words of a phrase that a document must have before the others are looked for.
RAREST = 2

COEF_COLUMNS = ("query_id", "clause", "slot", "field", "term", "coef", "avg_len")


def query_terms(queries: DataFrame) -> DataFrame:
    """One row per word of a query: (query_id, i, term)."""
    return queries.select("query_id", F.posexplode(T.words(F.col("query"))).alias("i", "term"))


@dataclasses.dataclass(frozen=True)
class Asked:
    """A table of queries and what the vocabulary knows about its strings.

    `queries` is (query_id, query); `lexicon` is (field, term, df, n_docs,
    avg_len) for every word, whole query and lower-cased query. Both are stored.
    """

    index: Index
    queries: DataFrame
    lexicon: DataFrame

    @property
    def words(self) -> DataFrame:
        return query_terms(self.queries)


def ask(index: Index, queries: DataFrame) -> Asked:
    """Look up all strings of the queries in one pass over the vocabulary."""
    queries = session.stash(queries.select("query_id", "query"), "queries")
    strings = F.concat(
        T.words(F.col("query")), F.array(F.col("query"), F.lower("query"))
    )
    distinct = session.stash(queries.select(F.explode(strings).alias("term")).distinct(), "strings")
    lexicon = index.vocab.join(distinct, "term").join(
        F.broadcast(index.field_stats), "field"
    )
    return Asked(index, queries, session.stash(lexicon, "lexicon"))


def _known(asked: Asked, boosts: dict[str, float]) -> DataFrame:
    """Lexicon rows of the named fields, with their boost."""
    return asked.lexicon.withColumn("boost", S.boost_of(F.col("field"), boosts)).where(
        F.col("boost").isNotNull()
    )


def _coef(df: DataFrame, clause: int, slot: Column, coef: Column) -> DataFrame:
    return df.select(
        "query_id", F.lit(clause).alias("clause"), slot.cast("int").alias("slot"),
        "field", "term", coef.alias("coef"), "avg_len",
    )


def fuzzy_terms(queries: DataFrame) -> DataFrame:
    """(query_id, field, qterm): words for analysed fields, the whole query for exact ones."""
    exact = [f for f in S.BEST_FIELDS if f in EXACT]
    analysed = [f for f in S.BEST_FIELDS if f not in EXACT]

    def per_field(rows: DataFrame, fields: list[str]) -> DataFrame:
        return rows.withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))

    words = query_terms(queries).select("query_id", F.col("term").alias("qterm"))
    whole = queries.select("query_id", F.col("query").alias("qterm"))
    return per_field(words, analysed).unionByName(per_field(whole, exact))


def best_fields_coefs(asked: Asked, max_expansions: int | None = None) -> DataFrame:
    """Fuzzy terms of six boosted fields; slot = field, so slots are summed then maxed.

    Exact fields take the whole query as one term. The expansions of a query
    term share one document frequency, that of the most frequent of them.
    """
    wanted = (
        fuzzy_terms(asked.queries)
        .groupBy("query_id", "field", "qterm")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    grown = session.stash(
        fuzzy_expand(asked.index, wanted.select("field", "qterm"), max_expansions), "expansions"
    )
    group = grown.groupBy("field", "qterm").agg(F.max("df").alias("group_df"))
    weight = (
        S.boost_of(F.col("field"), S.BEST_FIELDS)
        * S.scale_factor(F.col("avg_len"))
        * S.idf(F.col("n_docs"), F.col("group_df"))
        * F.col("times")
        * F.col("weight")
    )
    rows = (
        grown.join(group, ["field", "qterm"])
        .join(wanted, ["field", "qterm"])
        .join(F.broadcast(asked.index.field_stats), "field")
        .groupBy("query_id", "field", "term", "avg_len")
        .agg(F.sum(weight).alias("c"))
    )
    slot = S.boost_of(F.col("field"), {f: i for i, f in enumerate(S.BEST_FIELDS)})
    return _coef(rows, BEST, slot, F.col("c"))


def cross_fields_coefs(asked: Asked) -> DataFrame:
    """Term-centric match; slot = query term, so slots are maxed then summed.

    The analysed fields share one document frequency per term, the largest, and
    one document count. The director is exact and forms a group of its own.
    """
    terms = asked.words.groupBy("query_id", "term").agg(
        F.min("i").alias("slot"), F.count(F.lit(1)).alias("times")
    )
    known = _known(asked, S.CROSS_FIELDS)
    blended = known.groupBy("term").agg(F.max("df").alias("group_df"))
    stats = asked.index.field_stats.where(F.col("field").isin(*S.CROSS_FIELDS))
    group_docs = stats.agg(F.max("n_docs")).scalar()
    weight = (
        F.col("boost")
        * S.scale_factor(F.col("avg_len"))
        * S.idf(group_docs, F.col("group_df"))
        * F.col("times")
    )
    group = terms.join(known, "term").join(blended, "term")
    director = asked.queries.withColumnRenamed("query", "term").join(
        _known(asked, {"director": S.CROSS_DIRECTOR}), "term"
    )
    exact = F.col("boost") * S.idf(F.col("n_docs"), F.col("df"))
    return _coef(group, CROSS, F.col("slot"), weight).unionByName(
        _coef(director, CROSS_EXACT, F.lit(0), exact)
    )


def term_coefs(asked: Asked) -> DataFrame:
    """Whole query equal to a genre, or lower-cased equal to a keyword."""
    boosts = {"genres": S.GENRE_TERM, "keywords": S.KEYWORD_TERM}
    both = F.array(
        F.struct(F.lit("genres").alias("field"), F.col("query").alias("term")),
        F.struct(F.lit("keywords").alias("field"), F.lower("query").alias("term")),
    )
    wanted = asked.queries.select("query_id", F.explode(both).alias("w")).select("query_id", "w.*")
    known = wanted.join(_known(asked, boosts), ["field", "term"])
    slot = S.boost_of(F.col("field"), {f: i for i, f in enumerate(boosts)})
    return _coef(known, TERM, slot, F.col("boost") * S.idf(F.col("n_docs"), F.col("df")))


def join_postings(index: Index, rows: DataFrame, *more: str) -> DataFrame:
    """Postings of the (field, term) pairs in a stored table `rows`; ranges without any are not read."""
    cut = index.postings.select("id", *CUT, "term", "tf", "dl", *more)
    return cut.join(session.beside(with_range(rows, "term")), [*CUT, "term"]).drop("term_range")


# Planes of the scorer for many coefficients: the fields of the best-fields clause, exact terms, the exact cross field.
_TERM_PLANE, _EXACT_PLANE, _PLANES = len(S.BEST_FIELDS), len(S.BEST_FIELDS) + 1, len(S.BEST_FIELDS) + 2


def _merged(sums: list) -> list:
    best, cross = sums[0], np.maximum(sums[_EXACT_PLANE], sums[_PLANES])
    for field in sums[1:_TERM_PLANE]:
        best = np.maximum(best, field)
    return [(0, [best, cross, sums[_TERM_PLANE], *sums[_PLANES + 1 :]])]


def _clauses_of_many(index: Index, coefs: DataFrame, docs: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """(columns of docs, query_id, best, cross, term, phrases) from a large stored coefficient table; nothing moves."""
    plane = (
        F.when(F.col("clause") == BEST, F.col("slot")).when(F.col("clause") == TERM, _TERM_PLANE)
        .when(F.col("clause") == CROSS_EXACT, _EXACT_PLANE).otherwise(_PLANES + F.col("slot"))
    )
    rows = coefs.select("query_id", plane.cast("int").alias("plane"), "field", "term", "coef")
    names = ["best", "cross", "term"] + ["phrases"] * (phrases is not None)
    return score_documents(index, rows, _PLANES, True, _merged, names, docs, phrases).drop("label")


def clause_scores(index: Index, coefs: DataFrame) -> DataFrame:
    """(query_id, id, best, cross, term) from a coefficient table, in one pass."""
    coefs = session.stash(coefs, "coefs")
    if not session.is_small(coefs):
        return _clauses_of_many(index, coefs).select("query_id", "id", "best", "cross", "term")
    part = F.col("coef") * S.saturation(F.col("tf"), F.col("dl"), F.col("avg_len"))
    slots = (
        join_postings(index, coefs)
        .select("query_id", "id", "clause", "slot", part.alias("part"))
        .groupBy("query_id", "id", "clause", "slot")
        .agg(F.sum("part").alias("total"), F.max("part").alias("top"))
    )

    def of(clause: int, value: str):
        return F.when(F.col("clause") == clause, F.col(value))

    return (
        slots.groupBy("query_id", "id")
        .agg(
            F.max(of(BEST, "total")).alias("best"),
            F.sum(of(CROSS, "top")).alias("cross_terms"),
            F.max(of(CROSS_EXACT, "total")).alias("cross_exact"),
            F.sum(of(TERM, "total")).alias("term"),
        )
        .select(
            "query_id", "id", "best",
            F.greatest("cross_terms", "cross_exact").alias("cross"),
            "term",
        )
    )


def bm25_match(index: Index, queries: DataFrame) -> DataFrame:
    """Relevance per analysed field: (query_id, field, id, score)."""
    asked = ask(index, queries)
    terms = asked.words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    weight = F.col("times") * S.scale_factor(F.col("avg_len")) * S.idf(F.col("n_docs"), F.col("df"))
    rows = terms.join(_known(asked, dict.fromkeys(ANALYSED, 1.0)), "term").select(
        "query_id", "field", "term", weight.alias("coef"), "avg_len"
    )
    part = F.col("coef") * S.saturation(F.col("tf"), F.col("dl"), F.col("avg_len"))
    rows = session.stash(rows, "bm25-coefs")
    if not session.is_small(rows):
        plane = F.array_position(F.lit(list(ANALYSED)), F.col("field")) - 1
        coefs = rows.select("query_id", plane.cast("int").alias("plane"), "field", "term", "coef")
        found = score_documents(
            index, coefs, len(ANALYSED), False, lambda sums: [(i, [x]) for i, x in enumerate(sums)], ["score"]
        )
        return found.select("query_id", F.get(F.lit(list(ANALYSED)), F.col("label")).alias("field"), "id", "score")
    return (
        join_postings(index, rows)
        .groupBy("query_id", "field", "id")
        .agg(F.sum(part).alias("score"))
    )


def _only(index: Index, coefs: DataFrame, column: str) -> DataFrame:
    return (
        clause_scores(index, coefs)
        .select("query_id", "id", F.col(column).alias("score"))
        .where(F.col("score").isNotNull())
    )


def best_fields(
    index: Index, queries: DataFrame, max_expansions: int | None = None
) -> DataFrame:
    return _only(index, best_fields_coefs(ask(index, queries), max_expansions), "best")


def cross_fields(index: Index, queries: DataFrame) -> DataFrame:
    return _only(index, cross_fields_coefs(ask(index, queries)), "cross")


def term_match(index: Index, queries: DataFrame) -> DataFrame:
    return _only(index, term_coefs(ask(index, queries)), "term")


def phrase_occurrences(asked: Asked, clauses: dict[str, tuple[float, int]]) -> DataFrame:
    """(query_id, field, id, freq, score) of the queries as phrases.

    `clauses` gives the boost and slop of each field. An occurrence is a left
    edge from which every word is found within `slop` of its place; it counts
    1 / (1 + spread), so an exact phrase counts 1. Documents that lack a word
    are dropped before any position is unfolded, most of them before it is read.
    """
    words = asked.words
    boosts = {f: b for f, (b, _) in clauses.items()}
    known = words.join(_known(asked, boosts), "term")
    length = words.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("words")
    )
    whole = known.groupBy("query_id", "field").agg(
        F.sum(S.idf(F.col("n_docs"), F.col("df"))).alias("idf"), F.count(F.lit(1)).alias("found")
    )
    phrase = session.stash(
        known.join(whole, ["query_id", "field"])
        .join(length, "query_id")
        .where(F.col("found") == F.col("n"))
        .select(
            "query_id", "i", "field", "term", "n", "words", "df",
            (F.col("boost") * S.scale_factor(F.col("avg_len")) * F.col("idf")).alias("coef"),
            "avg_len",
            S.boost_of(F.col("field"), {f: s for f, (_, s) in clauses.items()})
            .cast("int").alias("slop"),
        ),
        "phrases",
    )
    # a document lacks a word unless it has the rarest two, which few have; the others are looked up there only
    by_df = Window.partitionBy("query_id", "field").orderBy("df", "term")
    rare = session.stash(
        phrase.select("query_id", "field", "term", "df", "words").distinct()
        .withColumn("r", F.row_number().over(by_df)).where(F.col("r") <= RAREST).drop("r", "df"),
        "rare-words",
    )
    likely = (
        join_postings(asked.index, rare)
        .groupBy("query_id", "field", "id", "words").agg(F.count(F.lit(1)).alias("seen"))
        .where(F.col("seen") == F.least(F.col("words"), F.lit(RAREST)))
        .select("query_id", "field", "id")
    )
    wanted = likely.join(session.beside(phrase.drop("df")), ["query_id", "field"])
    held = asked.index.postings.where(F.col("field").isin(*clauses)).select("id", "field", "term", "dl", "positions")
    docs = (
        # the wanted words of a bucket's documents are the hashed side; its postings pass by unsorted
        held.join(wanted.hint("shuffle_hash"), ["id", "field", "term"])
        .groupBy("query_id", "field", "id", "n", "words", "coef", "avg_len", "slop", "dl")
        .agg(F.collect_list(F.struct("i", "positions")).alias("parts"))
        .where(F.size("parts") == F.col("n"))
    )
    freq = F.when(F.col("slop") == 0, _phrase_freq(0)).otherwise(
        _phrase_freq(max(s for _, s in clauses.values()))
    )
    score = F.col("coef") * S.saturation(F.col("freq"), F.col("dl"), F.col("avg_len"))
    return (
        # unfolded rather than filtered: a filter would be pushed down as a second copy
        docs.withColumn("freq", F.explode(F.filter(F.array(freq), lambda f: f > 0)))
        .select("query_id", "field", "id", "freq", score.alias("score"))
    )


def _phrase_freq(slop: int) -> Column:
    """Occurrences in one document from `parts`, (place i in the query, positions).

    Only set operations on the position lists, so the cost is linear in them:
    an edge has spread w if every word is reached from it within w.
    """
    parts = F.col("parts")

    def starts(p: Column) -> Column:
        return F.transform(p["positions"], lambda x: x - p["i"])

    def earlier(xs: Column, by: int) -> Column:
        return F.transform(xs, lambda x: x - by) if by else xs

    def reached(w: int) -> Column:
        def edges(p: Column) -> Column:
            return F.flatten(F.array(*[earlier(starts(p), o) for o in range(w + 1)]))

        rest = F.slice(parts, F.lit(2), F.size(parts))
        first = edges(F.get(parts, F.lit(0)))
        return F.reduce(rest, first, lambda acc, p: F.array_intersect(acc, edges(p)))

    def places(e: Column) -> Column:
        nearest = F.transform(
            parts, lambda p: F.array_min(F.filter(starts(p), lambda s: s >= e)) + p["i"]
        )
        return F.size(F.array_distinct(nearest)) == F.col("n")

    def total(own: Column) -> Column:
        out, below = F.lit(0.0), F.lit(0)
        for w in range(slop + 1):
            within = F.size(own if w == slop else F.array_intersect(own, reached(w)))
            out, below = out + (within - below) / F.lit(float(w + 1)), within
        return out

    edges = F.array_intersect(F.flatten(F.transform(parts, starts)), reached(slop))
    # two query words must not share one place; that can only happen to repeated words
    apart = _let(
        edges, lambda e: F.when(F.col("words") < F.col("n"), F.filter(e, places)).otherwise(e)
    )
    return _let(apart, total)


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


EXACT_PHRASES = {f: (b, 0) for f, b in S.PHRASES.items()}
LOOSE_PHRASES = {f: (b, S.SLOP) for f, b in S.SLOPPY_PHRASES.items()}


def phrase_match(index: Index, queries: DataFrame) -> DataFrame:
    return phrase_occurrences(ask(index, queries), EXACT_PHRASES)


def phrase_slop(index: Index, queries: DataFrame) -> DataFrame:
    return phrase_occurrences(ask(index, queries), LOOSE_PHRASES)


def bool_should(
    index: Index, queries: DataFrame, max_expansions: int | None = None, docs: DataFrame | None = None
) -> DataFrame:
    """(query_id, id, score, columns of docs): all clauses of the keyword query, scores added.

    Each branch is reduced to one row per (query, document) where the postings
    lie. A document that matches a phrase matches a word of it, so phrases are
    joined onto the other clauses, and nothing moves; a session that demands all
    keys of a join to be keys of the layout brings the rows together by document.
    `docs` is (id, ...) of the index's documents.
    """
    asked = ask(index, queries)
    coefs = reduce(
        DataFrame.unionByName,
        [best_fields_coefs(asked, max_expansions), cross_fields_coefs(asked), term_coefs(asked)],
    )
    zero = F.lit(0.0)
    total = F.coalesce("best", zero) + F.coalesce("cross", zero) + F.coalesce("term", zero)
    phrases = phrase_occurrences(asked, EXACT_PHRASES | LOOSE_PHRASES)
    coefs = session.stash(coefs, "coefs")
    if not session.is_small(coefs):
        every = index.docs.select("id") if docs is None else docs
        scored = _clauses_of_many(index, coefs, every, phrases)
        score = (total + F.coalesce("phrases", zero)).alias("score")
        return scored.select("query_id", "id", score, *(c for c in every.columns if c != "id"))
    plain = clause_scores(index, coefs).select("query_id", "id", total.alias("score"))
    if index.spark.conf.get(session.JOIN_BY_ALL_KEYS, "true") == "false":
        added = phrases.groupBy("query_id", "id").agg(F.sum("score").alias("phrases"))
        found = plain.join(added, ["query_id", "id"], "left").select(
            "query_id", "id", (F.col("score") + F.coalesce("phrases", zero)).alias("score")
        )
    else:
        found = (
            plain.unionByName(phrases.select("query_id", "id", "score"))
            .repartition(index.buckets, "id")
            .groupBy("query_id", "id")
            .agg(F.sum("score").alias("score"))
        )
    return found if docs is None else found.join(docs, "id").select(*found.columns, *(c for c in docs.columns if c != "id"))


def bool_matches(
    index: Index, queries: DataFrame, max_expansions: int | None = None, docs: DataFrame | None = None
) -> DataFrame:
    """(query_id, id, columns of docs) of the documents `bool_should` scores, for totals and facets.

    A document that matches a cross-fields or phrase clause holds a word of the
    query in a field of the best-fields clause, so that clause and the exact
    terms find them all. No word order is read and nothing is shuffled.
    """
    asked = ask(index, queries)
    coefs = best_fields_coefs(asked, max_expansions).unionByName(term_coefs(asked))
    pairs = session.stash(coefs.select("query_id", "field", "term").distinct(), "match-terms")
    if not session.is_small(pairs):
        every = index.docs.select("id") if docs is None else docs
        one = pairs.select("query_id", F.lit(0).alias("plane"), "field", "term", F.lit(1.0).alias("coef"))
        return score_documents(index, one, 1, False, lambda sums: [(0, sums)], ["score"], every).select(
            "query_id", "id", *(c for c in every.columns if c != "id")
        )
    found = join_postings(index, pairs).select("query_id", "id").distinct()
    return found if docs is None else found.join(docs, "id").select(*found.columns, *(c for c in docs.columns if c != "id"))
