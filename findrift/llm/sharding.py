"""Minimax contiguous sharding of atomic groups.

Groups (equal texts) are ordered by a 64-bit hash of the text. The smallest
feasible capacity is found by binary search with a greedy check, and the order
is cut there. Sums of the ordered groups are read level by level: first over at
most BINS ranges of the hash, then only inside ranges where a cut can still lie,
until these hold single groups. The driver therefore sees a bounded number of
sums per level, whatever the table, and a level costs one aggregation.

A group larger than its fair share of what is left gets a shard of its own
first: no cut could make it smaller, and the other shards then stay even.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findrift.llm.store import dropped, parts, written

OVERHEAD = 16  # bytes counted for a document beside its text
BINS = 32_768  # ranges summed in the first level
FINE = 256  # parts of a range in a further level
BLOCK_ROWS = 200_000  # rows numbered by one task, about
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def greedy(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends of the shards (positions, exclusive) if every shard holds at most `capacity`, else None."""
    total = [0]
    for s in sums:
        total.append(total[-1] + s)
    ends, at = [], 0
    for _ in range(shards):
        at = bisect_right(total, total[at] + capacity) - 1
        ends.append(at)
        if at == len(sums):
            return ends + [at] * (shards - len(ends))
    return None


def smallest_capacity(sums: list[int], shards: int) -> int:
    """The least capacity for which `greedy` succeeds."""
    low = max(max(sums, default=0), -(-sum(sums) // shards))
    high = low
    while greedy(sums, high, shards) is None:
        high = 2 * high + 1
    while low < high:
        mid = (low + high) // 2
        if greedy(sums, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def giants(largest: list[tuple[int, int]], total: int, shards: int) -> list[tuple[int, int]]:
    """(key, sum) of the groups above the fair share of what is left, largest first."""
    alone = []
    for key, size in largest:
        left = shards - len(alone)
        if left <= 1 or size * left <= total:
            break
        alone.append((key, size))
        total -= size
    return alone


def _level(groups: DataFrame, edges: list[tuple[int, int]], fine: int) -> list[tuple[int, int, int, int]]:
    """(low, high, sum, groups) of up to `fine` equal parts of each hash range, one aggregation.

    Ranges are disjoint and ascending; a row finds its range by a literal lookup.
    """
    spark = groups.sparkSession
    table = spark.createDataFrame(
        [(k, lo, hi, max(1, -(-(hi - lo + 1) // fine))) for k, (lo, hi) in enumerate(edges)],
        "k int, lo bigint, hi bigint, width bigint",
    )
    key = F.col("key")
    rows = (
        groups.join(F.broadcast(table), key.between(F.col("lo"), F.col("hi")))
        .withColumn("part", F.expr("(key - lo) div width"))
        .groupBy("k", "part")
        .agg(
            F.min("key").alias("first"),
            F.max("key").alias("last"),
            F.sum("bytes").alias("s"),
            F.count("*").alias("n"),
        )
        .collect()
    )
    return sorted((r["first"], r["last"], int(r["s"]), r["n"]) for r in rows)


def cuts(groups: DataFrame, shards: int) -> tuple[list[int], list[int], int]:
    """(keys with a shard of their own, last keys of the other shards, capacity) for (key, bytes) groups.

    The second list has one key per remaining shard but the last; a shard holds
    the keys above the previous cut up to its own.
    """
    total = int(groups.agg(F.sum("bytes")).first()[0] or 0)
    if not total:
        return [], [], 0
    largest = [
        (r["key"], int(r["bytes"])) for r in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()
    ]
    alone = giants(largest, total, shards)
    own, rest = [k for k, _ in alone], shards - len(alone)
    g = groups.where(~F.col("key").isin(own)) if own else groups
    peak = max((s for k, s in largest if k not in own), default=0)
    width = (HIGH - LOW + 1) // BINS
    first = (
        g.groupBy(F.shiftright("key", width.bit_length() - 1).alias("b"))
        .agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("bytes").alias("s"), F.count("*").alias("n"))
        .collect()
    )
    bins = sorted((r["lo"], r["hi"], int(r["s"]), r["n"]) for r in first)
    while True:
        sums = [b[2] for b in bins]
        high = smallest_capacity(sums, rest)  # bins as atoms: enough for the groups too
        if all(b[3] == 1 for b in bins):
            break
        low = max(peak, -(-sum(sums) // rest))
        # where a cut of a capacity in [low, high] can lie: between the greedy cut
        # over whole bins and what the capacity could hold at the very most
        total_to, at, open_ = [0], 0, set()
        for s in sums:
            total_to.append(total_to[-1] + s)
        for k in range(1, rest + 1):
            at = max(at, bisect_right(total_to, total_to[at] + low) - 1)
            top = bisect_right(total_to, k * high)
            open_.update(range(at, min(top, len(bins))))
        split = [i for i in sorted(open_) if bins[i][3] > 1]
        if not split:
            break
        fine = max(2, min(FINE, -(-BINS // len(split))))
        found = _level(g, [(bins[i][0], bins[i][1]) for i in split], fine)
        chosen = set(split)
        bins = sorted([b for i, b in enumerate(bins) if i not in chosen] + found)
    ends = greedy([b[2] for b in bins], high, rest)
    return own, [bins[e - 1][1] for e in ends[: rest - 1] if e], high


def shard_of(key: Column, own: list[int], last: list[int]) -> Column:
    """Shard of a key: giants first, then the ranges between cuts."""
    out = F.lit(len(own))
    for i, k in enumerate(last):
        out = F.when(key > k, F.lit(len(own) + i + 1)).otherwise(out)
    for i, k in enumerate(own):
        out = F.when(key == k, F.lit(i)).otherwise(out)
    return out


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row; the law is `bytes`.

    Equal texts stay together, so sizes are as near equal as such groups allow:
    the largest shard is as small as any contiguous cut can make it. Null text
    counts as empty text and is one group with it. Null and repeated ids are
    rows like others. An empty table gives an empty result. Slots are gapless
    from 0 in each shard; rows are numbered in blocks, so that a shard or a
    group of copies is never one task.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    narrow = written(
        docs.select(
            F.col(f"`{id_col}`").alias("_id"),
            (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "sizes",
    )
    groups = written(narrow.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    own, last, _ = cuts(groups, shards)
    dropped(groups)
    n = narrow.count()
    blocks = max(1, -(-n // (BLOCK_ROWS * shards)))
    placed = narrow.withColumn("shard", shard_of(F.col("key"), own, last)).withColumn(
        "block", F.pmod(F.xxhash64("_id", "key"), F.lit(max(blocks, parts(docs.sparkSession) // shards + 1)))
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "block")
        .agg(F.count("*").alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    numbered = placed.withColumn(
        "row", F.row_number().over(Window.partitionBy("shard", "block").orderBy("_id", "key"))
    )
    return numbered.join(starts, ["shard", "block"]).select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("row") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
