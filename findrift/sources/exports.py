"""The daily id export: gzip NDJSON, one folder per day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift import schemas
from findrift.operators.paging import best_rows

LOOK_BACK_DAYS = 7
MAX_IDS = 100_000


def id_export_scan(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(id, popularity) of an export; other keys are ignored.

    A gzip file is one task to read, so the rows are spread right after it.
    """
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.read.schema(schemas.ID_EXPORT).json(path).repartition(n)


def latest_snapshot(
    spark: SparkSession, root: str, as_of: dt.date, look_back: int = LOOK_BACK_DAYS
) -> DataFrame:
    """The newest `dt=` partition among `as_of` and the days before it.

    Raises LookupError when none of the `look_back` days is there.
    """
    first = as_of - dt.timedelta(days=look_back - 1)
    # the listing alone gives the days; no file is opened for it
    files = spark.read.format("binaryFile").load(root)
    recent = files.where(F.col("dt").cast("date").between(F.lit(first), F.lit(as_of)))
    newest = recent.agg(F.max(F.col("dt").cast("date")).alias("dt")).first().dt
    if newest is None:
        raise LookupError(f"no id export between {first} and {as_of}")
    return id_export_scan(spark, f"{root}/dt={newest}").withColumn("dt", F.lit(newest))


def top_popular_ids(export: DataFrame, limit: int = MAX_IDS) -> DataFrame:
    """Ids with a positive popularity, most popular first, up to `limit`."""
    pop = F.coalesce("popularity", F.lit(0.0))
    known = export.select("id", pop.alias("popularity")).where(F.col("popularity") > 0)
    return best_rows(known, "popularity", "id", limit)
