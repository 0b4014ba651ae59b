"""Terms of log texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.functions import text as T


def log_postings(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Terms of the analysed fields of each row: (keys, field, term, tf, positions).

    Words are unfolded with their places and grouped by row and term, so the
    work is linear in the length of a text. `keys` name a row.
    """
    entries = F.array(
        *[F.struct(F.lit(f).alias("field"), T.words(F.col(f)).alias("terms")) for f in fields]
    )
    return (
        rows.select(*keys, F.inline(entries))
        .select(*keys, "field", F.posexplode("terms").alias("pos", "term"))
        .groupBy(*keys, "field", "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    )
