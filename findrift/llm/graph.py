"""Connected components of an edge table, by alternating large and small stars.

Nothing is collected; every round writes its edges, so lineage stays short. A
round is a constant number of shuffles over at most as many edges as there were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.llm.store import dropped, written

MAX_ROUNDS = 60  # far beyond the logarithm of any table; passing it is an error


def _round(e: DataFrame) -> DataFrame:
    """One large and one small star; `e` has distinct edges with a > b."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (
        both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    )
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def _print(e: DataFrame):
    return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v): root is the least node reachable.

    Nodes are bigints. Loops and rows with a null end are ignored; an empty
    table gives an empty result. Equal edges count once.
    """
    e = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        .distinct()
    )
    now = written(e, "edges")
    seen = _print(now)
    for _ in range(MAX_ROUNDS):
        after = written(_round(now), "edges")
        dropped(now)
        now, before, seen = after, seen, _print(after)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
