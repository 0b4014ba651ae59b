"""Writing, appending and upserting stored tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findrift import session


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Columns of a declared schema, in order; absent ones are null, others dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in T.StructType.fromDDL(schema).fields
        ]
    )


def refresh_table(df: DataFrame, path: str, schema: str, partitions: int | None = None) -> None:
    """Replace a stored table by rows in the declared schema."""
    out = conform(df, schema)
    if partitions:
        out = out.repartition(partitions)
    out.write.mode("overwrite").parquet(path)


def ensure_table(spark: SparkSession, name: str, schema: str, path: str, *by: str) -> DataFrame:
    """Create an empty table if there is none; an existing one is left as it is."""
    parted = f"PARTITIONED BY ({', '.join(by)})" if by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet {parted} LOCATION '{path}'")
    return spark.table(name)


def append_by_day(df: DataFrame, path: str, time: str) -> None:
    """Append rows, one folder per day of their time.

    Rows are clustered by day first, so a task writes few files; a large day is
    split over tasks at run time.
    """
    by_day = df.withColumn("dt", F.to_date(F.col(f"`{time}`")))
    by_day.hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(path)


def latest_versions(delta: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of each key.

    An aggregate, not a window: versions of a much-written key are reduced
    before the shuffle and never meet in one task.
    """
    rest = [c for c in delta.columns if c not in (key, order)]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("row")
    return delta.groupBy(key).agg(last).select(key, "row.*")


def upsert_by_id(base: DataFrame, delta: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Rows of `base`, replaced whole by the last version in `delta`, plus new ids."""
    last = session.stash(latest_versions(delta, key, order), "delta")
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.select(*base.columns))


def with_generated_ids(arrivals: DataFrame, time: str, key: str) -> DataFrame:
    """Add id = generated_{millis}_{key}.

    `key` names an arrival, so ids stay unique however many batches share a
    millisecond, and a repeated batch gives the same ids. No shuffle.
    """
    millis = F.unix_millis(F.col(time).cast("timestamp"))
    return arrivals.withColumn("id", F.concat_ws("_", F.lit("generated"), millis, F.col(key)))


def table_count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))


def stored_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or no rows if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
