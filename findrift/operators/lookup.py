"""Point lookups and prefix completion for a table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift import session
from findrift.functions import text as T
from findrift.operators.index import Index, with_range
from findrift.operators.paging import top_per_key


def lookup_by_id(ids: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """(query_id, id, found, columns); an unknown id is kept with found = false.

    The documents are first cut down to the wanted ids, past a broadcast of
    those, so that the outer join sees no more rows than there are requests.
    """
    wanted = session.stash(ids.select("id").distinct(), "lookup-ids")
    known = docs.select("id", *columns).join(wanted, "id", "left_semi")
    return ids.join(known.withColumn("hit", F.lit(True)), "id", "left").select(
        "query_id", "id", F.coalesce("hit", F.lit(False)).alias("found"), *columns
    )


def autocomplete(index: Index, queries: DataFrame, size: int) -> DataFrame:
    """Best `size` titles per query by number of query words that begin a title word.

    The query side is split and lower-cased only; the prefixes of the titles
    are stored with the index, once per document, and looked up by their range:
    (query_id, rank, id, score).
    """
    words = F.explode(T.words(F.col("query"))).alias("gram")
    wanted = session.stash(queries.select("query_id", words).distinct(), "prefix-words")
    counted = (
        index.prefixes.join(with_range(wanted, "gram"), ["term_range", "gram"])
        .groupBy("query_id", "id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    )
    return top_per_key(counted, "query_id", size).select("query_id", "rank", "id", "score")
