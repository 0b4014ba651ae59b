"""Documents similar to a given one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findrift import session
from findrift.functions import scoring as S
from findrift.operators.index import Index, postings
from findrift.operators.matching import join_postings
from findrift.operators.paging import top_per_key
from findrift.operators.requests import MAX_SIMILAR

# Fields compared, smallest document frequency, terms per document.
FIELDS = ("title", "overview", "genres", "keywords")
MIN_DOC_FREQ = 2
MAX_TERMS = 25
# Share of the chosen terms a document must have.
MATCH_SHARE = 0.3


def telling_terms(index: Index, anchors: DataFrame) -> DataFrame:
    """The best 25 (field, term) pairs of each anchor by tf * idf: (anchor, field, term, ...).

    `anchors` is (anchor). An id that is not in the catalogue has no terms.
    """
    all_docs = index.docs.agg(F.count(F.lit(1))).scalar()
    ids = session.stash(anchors.select("anchor").distinct(), "anchors")
    # the anchors' own documents are analysed again: far less than a look through all postings
    docs = index.docs.join(ids, F.col("id") == F.col("anchor"), "left_semi")
    own = postings(docs).where(F.col("field").isin(*FIELDS))
    own = session.stash(own.select(F.col("id").alias("anchor"), "field", "term", "tf"), "anchor-terms")
    vocab = index.vocab.where(F.col("field").isin(*FIELDS) & (F.col("df") >= MIN_DOC_FREQ))
    known = vocab.join(own, ["field", "term"])
    weight = F.col("tf") * (1 + F.ln((all_docs + 1) / (F.col("df") + 1)))
    best = Window.partitionBy("anchor").orderBy(F.desc("weight"), F.asc("field"), F.asc("term"))
    return (
        # rounded, so that equal weights are equal whatever the order of operations
        known.withColumn("weight", F.round(weight, 9))
        .withColumn("r", F.row_number().over(best))
        .where(F.col("r") <= MAX_TERMS)
        .select("anchor", "field", "term", "df")
    )


def similar_docs(index: Index, requests: DataFrame, *columns: str) -> DataFrame:
    """(query_id, anchor, rank, id, score, columns) for requests (query_id, anchor, limit).

    A document must have at least 30 % of the chosen terms; the anchor itself
    is left out; there are no signals. Anchors with the same chosen terms, such
    as copies of a text, are scored once: one more document than can be asked
    for is kept, so that each anchor can then be left out of its own list.
    """
    chosen = session.stash(telling_terms(index, requests), "telling-terms")
    # at most 25 pairs per anchor
    lists = chosen.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("field", "term"))).alias("terms")
    )
    groups = lists.groupBy("terms").agg(F.min("anchor").alias("sig"))
    members = session.stash(
        lists.join(groups, "terms").select(
            "anchor", "sig",
            F.greatest(F.lit(1), F.floor(F.size("terms") * MATCH_SHARE)).alias("needed"),
        ),
        "similar-groups",
    )
    coef = S.scale_factor(F.col("avg_len")) * S.idf(F.col("n_docs"), F.col("df"))
    rows = session.stash(
        chosen.join(members.where(F.col("anchor") == F.col("sig")), "anchor")
        .join(F.broadcast(index.field_stats), "field")
        .select("sig", "field", "term", "df", "needed", coef.alias("coef"), "avg_len"),
        "similar-coefs",
    )
    # Of n terms `needed` must match, so one of the n - needed + 1 rarest does: exact,
    # and frequent terms make no candidates.
    by_df = Window.partitionBy("sig").orderBy("df", "field", "term")
    n = F.count(F.lit(1)).over(Window.partitionBy("sig"))
    rare = session.stash(
        rows.withColumn("r", F.row_number().over(by_df)).withColumn("n", n)
        .where(F.col("r") <= F.col("n") - F.col("needed") + 1).select("sig", "field", "term"),
        "similar-rare",
    )
    candidates = session.stash(join_postings(index, rare).select("sig", "id").distinct(), "similar-candidates")
    part = F.col("coef") * S.saturation(F.col("tf"), F.col("dl"), F.col("avg_len"))
    # only the chosen terms' postings are looked at, and of these only the candidates'
    scored = (
        join_postings(index, rows.drop("df"))
        .join(candidates, ["sig", "id"], "left_semi")
        .groupBy("sig", "id", "needed")
        .agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("found"))
        .where(F.col("found") >= F.col("needed"))
        .select("sig", "id", "score")
    )
    best = top_per_key(scored, "sig", MAX_SIMILAR + 1).drop("rank")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc("id"))
    ranked = (
        members.select("anchor", "sig")
        .join(best, "sig")
        .where(F.col("id") != F.col("anchor"))
        .withColumn("rank", F.row_number().over(order))
    )
    found = (
        requests.join(ranked, "anchor")
        .where(F.col("rank") <= F.col("limit"))
        .select("query_id", "anchor", "rank", "id", "score")
    )
    if not columns:
        return found
    # documents come last: only rows of the result meet them
    return found.join(index.docs.select("id", *columns), "id").select(*found.columns, *columns)
