import random
import zlib

import pytest
from pyspark.sql import functions as F

from findrift.llm import sharding as S
from odd_rows import ODD


def brute(sums, shards):
    """Least possible largest part, by dynamic programming."""
    n = len(sums)
    upto = [0]
    for s in sums:
        upto.append(upto[-1] + s)
    best = upto[:]
    for _ in range(shards - 1):
        best = [min(max(best[j], upto[i] - upto[j]) for j in range(i + 1)) for i in range(n + 1)]
    return best[n]


@pytest.mark.parametrize("seed", range(30))
def test_smallest_capacity(seed):
    rng = random.Random(seed)
    sums = [rng.randint(0, 50) for _ in range(rng.randint(1, 25))]
    shards = rng.randint(1, 8)
    c = S.smallest_capacity(sums, shards)
    assert c == brute(sums, shards)
    assert S.greedy(sums, c, shards) is not None and (c == 0 or S.greedy(sums, c - 1, shards) is None)


@pytest.mark.parametrize("bins", [4, 64])
def test_levels_give_the_exact_cut(spark, monkeypatch, bins):
    monkeypatch.setattr(S, "BINS", bins)
    monkeypatch.setattr(S, "FINE", 3)
    rng = random.Random(bins)
    rows = [(rng.randint(S.LOW, S.HIGH), rng.randint(1, 100)) for _ in range(400)]
    rows = list({k: (k, b) for k, b in rows}.values()) + [(5, 3000), (6, 2500), (7, 1)]
    groups = spark.createDataFrame(rows, "key bigint, bytes bigint")
    own, last, capacity = S.cuts(groups, 8)
    sums = [b for k, b in sorted(rows) if k not in own]
    assert capacity == brute(sums, 8 - len(own))
    got = groups.withColumn("shard", S.shard_of(F.col("key"), own, last)).groupBy("shard").agg(F.sum("bytes").alias("b"))
    got = {r["shard"]: r["b"] for r in got.collect()}
    assert all(b <= capacity for s, b in got.items() if s >= len(own)) and sum(got.values()) == sum(b for _, b in rows)


def test_a_group_with_most_bytes_has_its_own_shard(spark):
    rows = [(i, "copy " * 50) for i in range(300)] + [(1000 + i, f"text {i} " * (i % 9 + 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = S.assign(df, 10).collect()
    size = {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert len({r["shard"] for r in got if r["doc_id"] < 300}) == 1
    rest = sorted(size.values())[:-1]
    assert len(size) == 10 and max(rest) < 1.1 * min(rest)


def test_odd_rows(odd, none):
    got = S.assign(odd, 4).collect()
    want = sorted(str((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for i, t in ODD)
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(4))
    assert len({r["shard"] for r in got if r["doc_id"] in (1, 2)}) == 1  # null and empty are one group
    assert S.assign(none, 4).count() == 0
