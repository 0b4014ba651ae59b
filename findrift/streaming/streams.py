"""Continuous appends: logs, retried logs, catalogue arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from findrift.sources import tables as TB

REFRESH = "30 seconds"


def read_logs(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Log rows from NDJSON files as they land."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def _writer(rows: DataFrame, checkpoint: str, drain: bool):
    w = rows.writeStream.option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True) if drain else w.trigger(processingTime=REFRESH)


def append_logs(rows: DataFrame, time: str, out: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Append to a table partitioned by day, a batch every 30 seconds.

    With `drain`, take what is there and stop.
    """
    by_day = rows.withColumn("dt", F.to_date(F.col(f"`{time}`")))
    return (
        _writer(by_day, checkpoint, drain)
        .format("parquet").partitionBy("dt").option("path", out).outputMode("append").start()
    )


def once_per_key(rows: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Drop repeats of a key.

    `delay` is how late a row may arrive; state older than that is released, and
    rows later than that are dropped.
    """
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def upsert_arrivals(
    arrivals: DataFrame, deltas: str, checkpoint: str, key: str = "id", order: str = "seq",
    drain: bool = False,
) -> StreamingQuery:
    """Store each batch's last versions under `deltas`; read them with `current`.

    A batch writes only what arrived, into a folder named by its number, so
    repeating a batch after a failure replaces the same folder.
    """

    def store(batch: DataFrame, number: int) -> None:
        cols = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("row"))
        last.select(key, "row.*").write.mode("overwrite").parquet(f"{deltas}/batch={number}")

    return _writer(arrivals, checkpoint, drain).foreachBatch(store).start()


def current(base: DataFrame, deltas: str, key: str = "id", order: str = "seq") -> DataFrame:
    """The base table with all stored deltas applied, later batches last."""
    spark = base.sparkSession
    delta = spark.read.parquet(deltas).withColumn("_at", F.struct("batch", order))
    return TB.upsert_by_id(base, delta.drop("batch", order), key, "_at")


def compact(base: DataFrame, deltas: str, out: str, schema: str) -> None:
    """Write base and deltas as a new full table."""
    TB.refresh_table(current(base, deltas), out, schema)
