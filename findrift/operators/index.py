"""Derived tables that ranked retrieval reads.

`docs` and `postings` are bucketed by document id. Every score is a sum per
(query, document), so with this layout the joins with query terms and all
aggregations run where the data lies, and a term that occurs in most documents
is spread over all buckets instead of falling into one task.

Inside a bucket `postings` are cut by field and by a hash range of the term
(`term_range`), which are partition columns: a join with a few terms reads their
ranges only, by dynamic partition pruning. `prefixes` holds the prefixes of title
words with their documents and is cut into ranges as well.
"""

from __future__ import annotations

import dataclasses
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift import session
from findrift.functions.dates import lenient_date
from findrift.operators import analysis, blocks

ROW_GROUP = 32 * 1024 * 1024

# Input per bucket: its postings are sorted by term in a task's memory.
BUCKET_BYTES = 16 * 1024 * 1024

# Hash ranges of the terms of a field, and of prefixes. A join with few terms
# reads their ranges; a bucket's file per field and range stays large enough to be read in one go.
RANGES = 8

# The stored tables of an index are compressed well; they are read more often than written.
PACKED = "zstd"

# Files that a task may hold open instead of sorting its rows by them; 0 sorts.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"

# Partition columns of the postings.
CUT = ("field", "term_range")


@dataclasses.dataclass(frozen=True)
class Index:
    """The stored tables of one catalogue."""

    path: str
    buckets: int
    docs: DataFrame
    postings: DataFrame
    vocab: DataFrame
    field_stats: DataFrame
    prefixes: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession


def index_docs(catalog: DataFrame) -> DataFrame:
    """Catalogue rows with the parsed date next to its source text."""
    return catalog.withColumn("release_dt", lenient_date(F.col("release_date")))


def by_id(catalog: DataFrame, partitions: int | None = None) -> DataFrame:
    """Lay rows by document id, before they unfold into terms."""
    n = partitions or int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return catalog.repartition(n, "id")


def postings(docs: DataFrame, by_term: bool = False) -> DataFrame:
    """(id, field, term, tf, dl, positions) of documents that lie by id; needs no shuffle.

    Rows of one id are one document. They are brought together by a sort inside
    their partition, of documents and not of their words. With `by_term` the rows
    of a partition come in the order of field and term.
    """
    fields = ("id", "title", "tagline", "overview", "cast", "director", "genres", "keywords")
    laid = docs.select(*fields).sortWithinPartitions("id")
    return blocks.postings_of(analysis.field_terms(laid), analysis.VALUE_GAP, by_term)


def vocab(post: DataFrame) -> DataFrame:
    """Document frequency of each term per field."""
    return post.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def field_stats(post: DataFrame) -> DataFrame:
    """Documents having a field, and its average length (null for exact fields)."""
    per_doc = post.groupBy("id", "field").agg(F.max("dl").alias("dl"))
    exact = F.col("field").isin(*analysis.EXACT)
    return per_doc.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("mean")
    ).select("field", "n_docs", F.when(~exact, F.col("mean")).alias("avg_len"))


def buckets_for(input_bytes: int, cores: int) -> int:
    """Enough buckets for all cores, and for a bucket to stay within a task's memory."""
    return max(cores, math.ceil(input_bytes / BUCKET_BYTES))


def range_of(key: Column) -> Column:
    """The hash range that a term or key lies in."""
    return F.pmod(F.xxhash64(key), F.lit(RANGES)).cast("int")


def with_range(rows: DataFrame, key: str) -> DataFrame:
    """The asked side of a join with a table cut into ranges.

    The filter drops nothing: it marks this side as one that selects, without
    which the planner does not derive a pruning of the other side from it.
    """
    return rows.withColumn("term_range", range_of(F.col(key))).where(F.col(key) >= "")


def prefix_keys(docs: DataFrame) -> DataFrame:
    """(term_range, gram, id): every distinct prefix of a word of a title."""
    grams = analysis.title_grams(docs).select("gram", "id").distinct()
    return grams.withColumn("term_range", range_of(F.col("gram")))


def _by_range(df: DataFrame, path: str, n: int, key: str) -> DataFrame:
    """Write a look-up table by range, each sorted by its key; a range with many rows is several files."""
    spark = df.sparkSession
    split = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(max(1, n // RANGES)))
    df.repartition(n, "term_range", split).sortWithinPartitions("term_range", key).write.partitionBy("term_range").option("compression", PACKED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bucketed(df: DataFrame, path: str, buckets: int, *sort: str, cut: tuple[str, ...] = (), files: int = 0) -> DataFrame:
    """Write rows that already lie by id in `buckets` partitions: one file per bucket, and per value of `cut`.

    Rows that come in order need no sort: then no `sort` is named, and a task
    holds its `files` open.
    """
    name = f"findrift_{uuid.uuid4().hex}"
    conf = df.sparkSession.conf  # Spark refuses more buckets than this setting names
    if buckets > int(conf.get("spark.sql.sources.bucketing.maxBuckets")):
        conf.set("spark.sql.sources.bucketing.maxBuckets", str(buckets))
    out = df.write.bucketBy(buckets, "id").option("path", path).option("parquet.block.size", ROW_GROUP).option("compression", PACKED)
    out = out.sortBy(*sort) if sort else out
    before = conf.get(OPEN_FILES)
    conf.set(OPEN_FILES, str(files))
    try:
        (out.partitionBy(*cut) if cut else out).saveAsTable(name)
    finally:
        conf.set(OPEN_FILES, before)
    return df.sparkSession.table(name)


def _prepare(spark: SparkSession) -> None:
    """Settings without which work on buckets moves them, or leaves the files of ended queries."""
    spark.conf.set(blocks.FREE_SHUFFLES, "true")  # the documents' way to their buckets is twice the input
    spark.conf.set(session.JOIN_BY_ALL_KEYS, "false")


def build_index(catalog: DataFrame, path: str, buckets: int | None = None) -> Index:
    """Write the tables under `path` and open them.

    `buckets` defaults to the session's shuffle partitions; `buckets_for` gives
    a number that fits the size of the input.
    """
    spark = catalog.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _prepare(spark)
    docs = _bucketed(by_id(index_docs(catalog), n), f"{path}/docs", n, "id")
    # read back by bucket, the documents unfold into postings without another shuffle
    ranged = postings(docs, by_term=True).withColumn("term_range", range_of(F.col("term")))
    fields = len(analysis.ANALYSED) + len(analysis.EXACT)
    post = _bucketed(ranged, f"{path}/postings", n, cut=CUT, files=fields * RANGES)
    # a fixed number of files, so that reading it back is as parallel as the postings
    vocab(post).repartition(n, "field", "term").sortWithinPartitions("field", "term").write.option("compression", PACKED).parquet(
        f"{path}/vocab"
    )
    field_stats(post).coalesce(1).write.parquet(f"{path}/field_stats")
    return Index(
        path, n, docs, post,
        spark.read.parquet(f"{path}/vocab"),
        spark.read.parquet(f"{path}/field_stats"),
        _by_range(prefix_keys(docs), f"{path}/prefixes", n, "gram"),
    )


def _reopen(spark: SparkSession, path: str, buckets: int, sort: str, cut: str = "") -> DataFrame:
    name = f"findrift_{uuid.uuid4().hex}"
    cols = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields
    )
    parted = f"PARTITIONED BY ({cut})" if cut else ""
    spark.sql(
        f"CREATE TABLE {name} ({cols}) USING parquet {parted} "
        f"CLUSTERED BY (id) SORTED BY ({sort}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    if cut:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def open_index(spark: SparkSession, path: str, buckets: int) -> Index:
    """Open tables written earlier with the same number of buckets."""
    _prepare(spark)
    return Index(
        path, buckets,
        _reopen(spark, f"{path}/docs", buckets, "id"),
        _reopen(spark, f"{path}/postings", buckets, "term", ", ".join(CUT)),
        *(spark.read.parquet(f"{path}/{t}") for t in ("vocab", "field_stats", "prefixes")),
    )
