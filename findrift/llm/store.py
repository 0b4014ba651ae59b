"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows handed to a Python worker at once: long texts are then a few hundred
# megabytes at worst, whatever the session's default is.
BATCH_ROWS = 2000

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_own: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A new path under `spark.checkpoint.dir`; only a local session may leave that unset."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not root:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="llm-")
        root = f"file://{_own[app]}"
    return f"{root.rstrip('/')}/llm/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a written table: cuts the lineage, survives lost executors, shows its size."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame, levels: int = 1) -> None:
    """Remove the files of a written table that no later plan reads; `levels` is 2 if its files lie in folders by a column."""
    spark = df.sparkSession
    for name in {f.rsplit("/", levels)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def batched(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, and let workers beside the driver find this package."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which its owner fits to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
