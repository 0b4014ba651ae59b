"""Bulk files: an action line followed by a document line, and bulk responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findrift import schemas

CATALOG_BATCH = 100


def bulk_lines(docs: DataFrame, index: str | None = None, id_column: str | None = None) -> DataFrame:
    """(value) of two-line records; without `id_column` the reader assigns ids."""
    body = F.to_json(F.struct(*[c for c in docs.columns if c != id_column]))
    if id_column is None:
        action = F.lit('{"index":{}}')
    else:
        target = [F.lit(index).alias("_index")] if index else []
        action = F.to_json(
            F.struct(F.struct(*target, F.col(id_column).cast("string").alias("_id")).alias("index"))
        )
    return docs.select(F.concat(action, F.lit("\n"), body).alias("value"))


def write_bulk_pairs(
    docs: DataFrame, path: str, batch: int = CATALOG_BATCH, index: str | None = None,
    id_column: str | None = None,
) -> None:
    """Write bulk files of at most `batch` documents each."""
    bulk_lines(docs, index, id_column).write.option("maxRecordsPerFile", batch).text(path)


def bulk_pairs_scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(_id, document fields) from bulk files.

    Lines that are not blank come in pairs, whatever they hold: a document may
    start like an action. Each line is numbered within its file (a split counts
    its lines, the splits before it give the offset), and pairs meet by number.
    """
    lines = (
        spark.read.text(path)
        .select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
        .where(F.trim("value") != "")
        .withColumn("m", F.monotonically_increasing_id())
    )
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy("f", "b")
        .agg(F.min("m").alias("first"), F.count("*").alias("n"))
        .select("f", "b", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    )
    line = F.col("m") - F.col("first") + F.col("skip")
    pair = (
        lines.join(splits, ["f", "b"])
        .select("f", F.expr("(m - first + skip) div 2").alias("k"), (line % 2 == 0).alias("is_action"), "value")
        .groupBy("f", "k")
        .agg(
            F.max(F.when(F.col("is_action"), F.col("value"))).alias("action"),
            F.max(F.when(~F.col("is_action"), F.col("value"))).alias("body"),
        )
    )
    ids = [F.get_json_object("action", f"$.{verb}._id") for verb in ("index", "create")]
    return (
        pair.where(F.col("body").isNotNull())
        .select(F.coalesce(*ids).alias("_id"), F.from_json("body", schema).alias("doc"))
        .select("_id", "doc.*")
    )


def bulk_outcome(responses: DataFrame) -> DataFrame:
    """Tallies over bulk responses (value): items, indexed (status 2xx), without_error, failed."""
    item = responses.select(
        F.explode(F.from_json("value", schemas.BULK_RESPONSE)["items"]).alias("item")
    ).select("item.index.*")
    ok = F.col("status").between(200, 299)
    return item.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(ok).alias("indexed"),
        F.count_if(F.col("error").isNull()).alias("without_error"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"),
    )
