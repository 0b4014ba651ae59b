"""Links between vectors of equal label by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors. A vector is
described by its nearest pivots in order; the inverted list of a pivot holds the
vectors that name it. Two vectors are candidates where they share enough pivots,
and candidates are verified by cosine in double precision. Equal vectors are one
node, however many copies there are. A long list is cut into blocks and its
pairs of blocks are dealt to tasks, so a list that holds a third of all vectors
is many tasks of the same size. A pair is counted at its first shared pivot only.
A task returns sums and a spanning forest of its links, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findrift.llm.graph import components
from findrift.llm.store import batched, dropped, written

THRESHOLD = 0.93
PIVOTS = 4  # per square root of the vectors
MOST_PIVOTS = 16_384  # bound of the sample and of what is sent to the workers
NEAREST = 12  # pivots that describe a vector
SHARED = 3  # pivots two candidates have in common
BLOCK = 1024  # vectors of a block

NODES = "node bigint, label_key bigint, copies bigint, v binary"


def valid(col: Column, label: Column) -> Column:
    """Vectors that can link: labelled, not null, finite in every component, not zero."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(col, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & col.isNotNull() & finite & some, F.lit(False))


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest pivots of each unit vector, nearest first, ties by number."""
    out = []
    for lo in range(0, len(x), 1024):
        sim = x[lo : lo + 1024] @ pivots.T
        out.append(np.argsort(-sim, axis=1, kind="stable")[:, :k])
    return np.concatenate(out).astype(np.int32) if out else np.zeros((0, k), np.int32)


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    peak = np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    x = x / peak
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = [np.array(x, "<f8").tobytes() for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(v, pa.binary())], names=["node", "label_key", "copies", "v"]
        )


LISTED = "node bigint, label_key bigint, copies bigint, v binary, near binary, pivot int"


def _listed(pivots: dict[int, np.ndarray], k: int):
    """One row per vector and pivot it names; pivots are those of the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(3).to_pylist()
            size = np.array([len(b) // 8 for b in blobs], np.int64)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                if d not in pivots:
                    near = np.zeros((len(at), 1), np.int32)  # no sample of this length: one list for all
                else:
                    near = nearest(_unit([blobs[i] for i in at]), pivots[d], k)
                rows = batch.take(pa.array(np.repeat(at, near.shape[1])))
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns,
                        pa.array([r.tobytes() for r in near for _ in range(len(r))], pa.binary()),
                        pa.array(near.ravel()),
                    ],
                    names=["node", "label_key", "copies", "v", "near", "pivot"],
                )

    return run


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links a[i] - b[i]."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


LINKS = "u bigint, v bigint, n bigint"


def _linked(shared: int, threshold: float):
    """Links between two blocks of a list (or within one): sums per node and a forest."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        pivot, i, j = (rows.column(c)[0].as_py() for c in ("pivot", "i", "j"))
        block = rows.column("block").to_numpy()
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        x = _unit(rows.column("v").to_pylist())
        near = np.frombuffer(b"".join(rows.column("near").to_pylist()), np.int32).reshape(len(x), -1)
        used, place = np.unique(near, return_inverse=True)
        sign = np.zeros((len(x), len(used)), np.float32)
        sign[np.arange(len(x))[:, None], place.reshape(near.shape)] = 1
        need = min(shared, near.shape[1])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        us, vs = [], []
        for lo in range(0, len(left), 256):
            at = left[lo : lo + 256]
            cand = sign[at] @ sign[right].T >= need
            if i == j:
                cand &= node[at][:, None] < node[right][None, :]
            p, q = np.nonzero(cand & (x[at] @ x[right].T >= threshold))
            p, q = at[p], right[q]
            for cut in range(0, len(p), 65536):  # count a pair at its first shared pivot
                a, b = p[cut : cut + 65536], q[cut : cut + 65536]
                common = (near[a][:, :, None] == near[b][:, None, :]).any(axis=2)
                first = np.where(common, near[a], np.iinfo(np.int32).max).min(axis=1) == pivot
                us.append(a[first])
                vs.append(b[first])
        if not us:
            return schema.empty_table()
        a, b = np.concatenate(us), np.concatenate(vs)
        many = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
        some = np.flatnonzero(many)
        edges = forest(node[a], node[b])
        return pa.table(
            {
                "u": pa.array(node[some].tolist() + [e[0] for e in edges], pa.int64()),
                "v": pa.array([None] * len(some) + [e[1] for e in edges], pa.int64()),
                "n": pa.array(many[some].astype(np.int64).tolist() + [None] * len(edges), pa.int64()),
            }
        )

    return run


def _sample(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by vector length: the vectors of least hash, as many as the table's size asks for."""
    out = {}
    sizes = nodes.groupBy(F.octet_length("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(64)
    for r in sizes.collect():
        want = min(MOST_PIVOTS, max(16, int(PIVOTS * r["count"] ** 0.5)))
        rows = (
            nodes.where(F.octet_length("v") == r["size"])
            .orderBy(F.xxhash64("node", F.lit(7)), "node")
            .limit(want)
            .select("v")
            .collect()
        )
        if len(rows) >= 16:
            out[r["size"] // 8] = _unit([bytes(x["v"]) for x in rows])
    return out


def link(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    near: int = NEAREST,
    shared: int = SHARED,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Vectors link when label and length are equal and the cosine is at least
    `threshold`. Null, zero and non-finite vectors and rows without a label link
    with nothing. Repeated rows and equal vectors link with each other. A null id
    takes part in links but is never the least of a component; it is not kept.
    An empty table gives an empty result. Pivots are a sample of at most
    MOST_PIVOTS vectors; every vector is indexed. A list of any length is compared
    whole, block by block. Links whose ends share fewer than `shared` pivots are
    missed; tests measure that.
    """
    spark = vectors.sparkSession
    batched(spark)
    # adding 0.0 makes one zero of the two
    doubles = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), doubles.alias("x")
    )
    rows = rows.withColumn("ok", valid(F.col("x"), F.col("label"))).withColumn(
        "label_key", F.when(F.col("ok"), F.xxhash64("label"))
    )
    rows = written(rows.withColumn("node", F.when(F.col("ok"), F.xxhash64("label", "x"))), "vectors")
    same = rows.where("ok").groupBy("node").agg(
        F.first("label_key").alias("label_key"), F.count("*").alias("copies"), F.first("x").alias("x"),
        F.min("id").alias("least"),
    )
    same = written(same, "classes")
    nodes = written(same.select("node", "label_key", "copies", "x").mapInArrow(_packed, NODES), "nodes")
    pivots = _sample(nodes)
    listed = written(nodes.mapInArrow(_listed(pivots, near), LISTED), "lists")
    lengths = listed.groupBy("label_key", "pivot", F.octet_length("v").alias("size")).agg(F.count("*").alias("n"))
    lengths = lengths.where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    # every block meets itself and all later ones
    dealt = (
        listed.withColumn("size", F.octet_length("v"))
        .join(lengths, ["label_key", "pivot", "size"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .select("label_key", "pivot", "size", "i", "j", "block", "node", "copies", "v", "near")
    )
    links = written(
        dealt.groupBy("label_key", "pivot", "size", "i", "j").applyInArrow(_linked(shared, threshold), LINKS), "links"
    )
    dropped(listed)
    found = components(links.where("v is not null").select("u", "v"))
    sums = links.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    named = (
        same.select("node", "copies", "least")
        .join(found, "node", "left")
        .join(sums, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    lows = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(lows, "root").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return (
        rows.where("ok")
        .join(written(named, "named"), "node")
        .select(F.col("id").alias(id_col), F.col("n_links").cast("bigint").alias("n_links"), "component_id", kept.alias("kept"))
        .unionAll(
            rows.where("not ok").select(
                F.col("id"), F.lit(0).cast("bigint"), F.col("id"), F.col("id").isNotNull()
            )
        )
    )
