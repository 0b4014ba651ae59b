"""Session set-up and the shared working folder.

Joins carry no hint that depends on a row count: side tables are stored first
(`stash`), so the planner knows their bytes and broadcasts those under its
threshold; beyond it, it shuffles and splits skewed keys at run time. Where the
other side is the vocabulary or the postings, `beside` allows more bytes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a (query, document) join stay with their document's bucket if this is false.
JOIN_BY_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"

_local_root: str | None = None


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; `conf` keys use `_` for `.`."""
    b = SparkSession.builder.appName("findrift")
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(JOIN_BY_ALL_KEYS, "false")
        # stream state of many keys is kept on disk, not on the heap
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder of this session.

    The shared folder is `spark.checkpoint.dir`. Only a local session without
    that setting falls back to a temporary folder; a cluster must name one.
    """
    global _local_root
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not root:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="findrift-")
        root = _local_root
    return f"{root.rstrip('/')}/findrift/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Cuts the lineage at a stored table, so a lost executor costs a re-read and
    not the whole plan, and gives the planner the real size.
    """
    spark = df.sparkSession
    path = workspace(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Bytes of a stored side table that are still sent to all tasks where the other side is far larger.
SENT = 8 * 1024 * 1024


def stored_bytes(df: DataFrame) -> int:
    """What the planner takes for the size of a stored table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _threshold(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def is_small(df: DataFrame) -> bool:
    """The planner would broadcast this stored table by itself."""
    return stored_bytes(df) <= _threshold(df.sparkSession)


def beside(df: DataFrame) -> DataFrame:
    """A stored side table, with a hint to broadcast it while its bytes are few; a session may forbid broadcasts."""
    if _threshold(df.sparkSession) < 0 or stored_bytes(df) > SENT:
        return df
    return F.broadcast(df)
