"""Near-duplicate classes by a set-similarity join over word shingles, with vertically cut verification.

The global order of shingles is (documents that hold it, hash): rare ones first.
Two sets of Jaccard similarity t or more share a shingle among the first
n - ceil(t n) + 1 of each in any such order, and shingles of one document only
can be skipped, so a document whose rare shingles fill that prefix links with
nothing and is gone at once.

1. Map tasks send their shingles, packed, to ranges of the hash; a range finds
   the shingles of two documents or more and returns those, packed, to the
   chunk of documents they came from. This is the only pass over all shingles.
2. A chunk orders the shared shingles of each document and finds its prefix.
   Equal sets are one node from here on, however many copies there are.
3. Prefix shingles are joined with a few leaders of their list, which gives a
   number of pairs linear in the prefixes. Pairs are verified: the order is cut into
   FRAGMENTS at pivots, the same for all sets, which fall where a histogram of all
   shared shingles says that each fragment gets about as many of them; partial
   overlaps are counted per fragment and summed. Fragments make no candidates.
4. Linked pairs give components. Pairs of a shared prefix shingle whose ends are
   in different components, and only those, are then verified too, unless a
   parity word of their shingles already shows that they differ too much; so
   groups of thousands of near copies never become all their pairs, and no link
   between components is missed. Only components are returned, so pairs inside one need
   not be looked at. The shorter set of a pair must meet the other so early that what
   follows can still be shared by both, and what follows limits the length of the
   other; pairs are joined on bands of that length, so a passage of many documents
   that is too short to link them makes no pairs at all.

No list is collected anywhere; every step is a join, an aggregation, or a packed
exchange whose pieces are bounded by the batch and the number of ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.llm.graph import components
from findrift.llm.store import batched, dropped, parts, written
from findrift.llm.words import SHINGLE, U, mix, shingles

PERCENT = 80  # similarity: 100 * intersection >= PERCENT * union
FRAGMENTS = 4
LEADERS = 3
BAND = 1.05  # lengths of a band differ by less than this factor
SALTS = 32  # parts of a component that learn its least id
BITS = 1024  # of the parity word that tells unlike sets apart
TOKEN = U((1 << 48) - 1)  # bits of a shingle hash that are sent
FLUSH = 1_500_000  # shingles held by a map task before they are sent on

_B, _I32, _I64 = pa.binary(), pa.int32(), pa.int64()
# kind 0: documents of a chunk (a: sizes, b: set hashes, c: ids); kind 1: shingles of a range
# (a: hashes, b: documents of the chunk, and on the way back c: documents that hold each)
SENT = pa.schema([("kind", _I32), ("range", _I32), ("chunk", _I64), ("a", _B), ("b", _B), ("c", _B)])
SENT_DDL = "kind int, range int, chunk bigint, a binary, b binary, c binary"


def prefix_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """First shingles of a set of n that a similar set must meet."""
    return n + (-(percent * n) // 100) + 1


def _six(x: np.ndarray) -> bytes:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _small(x: np.ndarray) -> bytes:
    """A mark and whole numbers: two bytes each where all fit, else four (at most 2**32 - 1)."""
    if not len(x) or x.max() < 1 << 16:
        return b"\x02" + x.astype("<u2").tobytes()
    return b"\x04" + np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes()


def _unsmall(b: bytes) -> np.ndarray:
    return np.frombuffer(b[1:], "<u2" if b[:1] == b"\x02" else "<u4").astype(np.int64)


def _send(ranges: int, width: int):
    """Shingles of the texts by range of their hash, and a line per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        held, sizes, ids, total = [], [], [], 0

        def out():
            g, n = np.concatenate(held), np.concatenate(sizes)
            d = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            # the set as one number: sums of independent mixes of its shingles
            sets = np.zeros(len(n), U)
            np.add.at(sets, d, mix(g ^ U(0xA5A5F00D5EEDC0DE)))
            sets = mix(sets + n.astype(U))
            sets[n == 0] = 0
            named = pa.chunked_array(ids).combine_chunks()
            where = ((chunk >> 32) + 7919 * (chunk & 0xFFFFFFFF)) & 0x7FFFFFFF
            yield (0, where, chunk, n.astype("<i8").tobytes(), sets.astype("<u8").tobytes(), _packed(named))
            g = g & TOKEN
            order = np.argsort(g, kind="stable")
            where = (g[order] >> U(16)) * U(ranges) >> U(32)
            ends = np.searchsorted(where, np.arange(ranges + 1).astype(U))
            for r in np.flatnonzero(np.diff(ends)).tolist():
                cut = order[ends[r] : ends[r + 1]]
                yield (1, r, chunk, _six(g[cut]), _small(d[cut]), None)

        def rows(found):
            part = []
            for row in found:
                part.append(row)
                if len(part) == 64:
                    yield _batch(part)
                    part = []
            if part:
                yield _batch(part)

        for batch in batches:
            g, first = shingles(batch.column(1), width)
            held.append(g)
            ids.append(batch.column(0))
            sizes.append(np.diff(first))
            total += len(g)
            if total >= FLUSH:
                yield from rows(out())
                held, sizes, ids, total, chunk = [], [], [], 0, chunk + 1
        if sizes:
            yield from rows(out())
        pa.default_memory_pool().release_unused()

    return run


def _packed(col: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays([col], names=["_id"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document from the lines of the chunks: id, size and set."""
    for batch in batches:
        for a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            n, node = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
            ids = pa.ipc.open_stream(c).read_all().column(0).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(node)], names=["_id", "n_shingles", "node"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SENT, strict=True)], schema=SENT
    )


def _shared(rows: pa.Table) -> pa.Table:
    """Of one range: shingles of two or more documents, back by chunk, with their counts."""
    kind = rows.column("kind")[0].as_py()
    if kind == 0:
        return rows.select(SENT.names).cast(SENT)
    chunks = rows.column("chunk").to_pylist()
    g, d, c = [], [], []
    for k, (a, b) in enumerate(zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), strict=True)):
        g.append(_unsix(a))
        d.append(_unsmall(b))
        c.append(np.full(len(g[-1]), k, np.int32))
    g, d, c = np.concatenate(g), np.concatenate(d), np.concatenate(c)
    order = np.argsort(g, kind="stable")
    s = g[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    df = np.diff(np.append(at, len(s)))[np.cumsum(new) - 1] if len(s) else s.astype(np.int64)
    keep = df > 1
    order, df = order[keep], df[keep]
    g, d, c = g[order], d[order], c[order]
    by = np.argsort(c, kind="stable")
    g, d, c, df = g[by], d[by], c[by], df[by]
    ends = np.searchsorted(c, np.arange(len(chunks) + 1))
    out = []
    r = rows.column("range")[0].as_py()
    for k in np.flatnonzero(np.diff(ends)).tolist():
        cut = slice(ends[k], ends[k + 1])
        out.append((1, r, chunks[k], _six(g[cut]), _small(d[cut]), _small(df[cut])))
    if not out:
        return SENT.empty_table()
    return pa.Table.from_batches([_batch(out)])


NODES = "node bigint, n bigint, before bigint, prefix int, tokens binary, cuts array<int>, bits array<bigint>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared shingles by the binary logarithm of the number of documents that hold them."""
    total = np.zeros(33, np.int64)
    for batch in batches:
        for c in batch.column(0).to_pylist():
            total += np.bincount(np.log2(_unsmall(c)).astype(np.int64), minlength=33)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["step", "many"])


def _pivots(back: DataFrame) -> list[int]:
    """FRAGMENTS - 1 document counts at which the global order is cut; at most 33 rows are gathered."""
    found = back.where("kind = 1").select("c").mapInArrow(_counted, "step bigint, many bigint")
    steps = found.groupBy("step").agg(F.sum("many").alias("many")).orderBy("step").collect()
    total, sum_, out = sum(r.many for r in steps), 0, []
    for r in steps:
        sum_ += r.many
        while len(out) < FRAGMENTS - 1 and sum_ * FRAGMENTS >= total * (len(out) + 1):
            out.append(2 << r.step)
    return out


def _bits(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens in each of BITS places, as 64-bit words.

    Where the bits of two sets differ, the sets differ: the number of differing
    bits never exceeds the number of tokens in one set only.
    """
    odd = np.bincount((tokens % U(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _ordered(percent: int, pivots: list[int]):
    """Of one chunk: shared shingles of each document that can link, in the global order, and its cuts."""
    schema = pa.schema([("node", _I64), ("n", _I64), ("before", _I64), ("prefix", _I32), ("tokens", _B),
                        ("cuts", pa.list_(_I32)), ("bits", pa.list_(_I64))])

    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_pylist()
        a, b, c = (rows.column(x).to_pylist() for x in "abc")
        k = kind.index(0)
        n, sets = np.frombuffer(a[k], "<i8"), np.frombuffer(b[k], "<i8")
        at = [i for i, x in enumerate(kind) if x == 1]
        if not at:
            return schema.empty_table()
        g = np.concatenate([_unsix(a[i]) for i in at])
        d = np.concatenate([_unsmall(b[i]) for i in at])
        f = np.concatenate([_unsmall(c[i]) for i in at])
        order = np.lexsort((g, f, d))
        g, d, f = g[order], d[order], f[order]
        ends = np.searchsorted(d, np.arange(len(n) + 1))
        have = np.diff(ends)
        before = n - have  # shingles of this document only come first
        prefix = prefix_size(n, percent) - before
        done, out = set(), []
        for i in np.flatnonzero((have > 0) & (prefix > 0)).tolist():
            if (sets[i], n[i]) not in done:  # copies in this chunk
                done.add((sets[i], n[i]))
                out.append((int(sets[i]), int(n[i]), int(before[i]), int(min(prefix[i], have[i])),
                            _six(g[ends[i] : ends[i + 1]]), np.searchsorted(f[ends[i] : ends[i + 1]], pivots).astype(np.int32),
                            _bits(g[ends[i] : ends[i + 1]])))
        if not out:
            return schema.empty_table()
        return pa.table([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


POSTINGS = "token bigint, node bigint, n bigint, pos bigint"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix shingles of each node with their place in the global order (from 0)."""
    for batch in batches:
        node, n, before, prefix, tokens = (batch.column(i) for i in range(5))
        prefix = prefix.to_numpy().astype(np.int64)
        lists = [_unsix(t[: 6 * p]).view("<i8") for t, p in zip(tokens.to_pylist(), prefix, strict=True)]
        pos = [b + np.arange(p) for b, p in zip(before.to_numpy(), prefix, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(lists) if lists else [], _I64),
                pa.array(np.repeat(node.to_numpy(), prefix)),
                pa.array(np.repeat(n.to_numpy(), prefix)),
                pa.array(np.concatenate(pos) if pos else [], _I64),
            ],
            names=["token", "node", "n", "pos"],
        )


SEGMENTS = "node bigint, n bigint, fragment int, segment array<bigint>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared shingles of each node, cut at the same places of the global order for all nodes."""
    for batch in batches:
        rows = []
        for node, n, tokens, cuts in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True):
            for k, part in enumerate(np.split(_unsix(tokens), cuts)):
                if len(part):
                    rows.append((node, n, k, part.view("<i8")))
        for lo in range(0, len(rows), 1024):
            node, n, k, s = zip(*rows[lo : lo + 1024], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, _I64), pa.array(n, _I64), pa.array(k, _I32), pa.array(list(s), pa.list_(_I64))],
                names=["node", "n", "fragment", "segment"],
            )


def _may_link(percent: int):
    """Length and position filters of a pair that meets at these places: exact upper bounds."""
    bound = F.lit(1) + F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) - 1
    return (100 + percent) * bound >= percent * (F.col("n1") + F.col("n2"))


def _differ_little(percent: int):
    """The bits of two sets allow that they are similar: an exact bound on what is in one set only."""
    bits = reduce(add, [F.bit_count(F.get("b1", F.lit(i)).bitwiseXOR(F.get("b2", F.lit(i)))) for i in range(BITS // 64)])
    apart = F.col("f1") + F.col("f2") + bits  # shingles of one document only are never shared
    return (100 + percent) * apart <= (100 - percent) * (F.col("n1") + F.col("n2"))


def verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of `pairs` whose sets are similar: partial overlaps per fragment, summed per pair."""
    left = segments.select(
        F.col("node").alias("u"), F.col("n").alias("n1"), "fragment", F.col("segment").alias("s1")
    )
    right = segments.select(
        F.col("node").alias("v"), F.col("n").alias("n2"), "fragment", F.col("segment").alias("s2")
    )
    partial = (
        pairs.join(left, "u")
        .join(right, ["v", "fragment"])
        .select("u", "v", "n1", "n2", F.size(F.array_intersect("s1", "s2")).alias("shared"))
    )
    return (
        partial.groupBy("u", "v", "n1", "n2")
        .agg(F.sum("shared").alias("o"))
        .where((100 + percent) * F.col("o") >= percent * (F.col("n1") + F.col("n2")))
        .select("u", "v")
    )


def across(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that a prefix shingle allows to be similar, the shorter set first.

    A set of n that meets a set at least as long at place p shares at most n - p
    shingles with it, which bounds the other's length; the join is on that length's bands.
    """

    def side(k: int) -> DataFrame:
        names = {"node": "x", "n": "n", "pos": "p", "root": "r", "before": "f", "bits": "b"}
        return open_.select("token", *[F.col(c).alias(f"{to}{k}") for c, to in names.items()])

    def band(n):
        return F.floor(F.log(n) / math.log(BAND)).cast("int")

    longest = F.expr(f"({100 + percent} * (n1 - p1) - {percent} * n1) div {percent}")
    short = side(1).where(longest >= F.col("n1")).withColumn(
        "band", F.explode(F.sequence(band(F.col("n1")), band(longest)))
    )
    long = side(2).withColumn("band", band(F.col("n2")))
    apart = (F.col("r1") != F.col("r2")) & (
        (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("x1") < F.col("x2")))
    )
    return short.join(long, ["token", "band"]).where(apart & _may_link(percent))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x1", "x2").alias("u"), F.greatest("x1", "x2").alias("v")).distinct()


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = SHINGLE
) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row.

    component_id is the least id reachable by links, its own included. A text of
    fewer words than `width` is one shingle; a null, empty or blank text has no
    shingle and is its own component. Repeated rows are copies of each other. A
    null id takes part in links; it is never the least, and a component of null
    ids only has a null id. Other columns are not read. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    batched(spark)
    ranges = 2 * parts(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    back = written(
        text.mapInArrow(_send(ranges, width), SENT_DDL)
        .groupBy("kind", "range")
        .applyInArrow(_shared, SENT_DDL),
        "shared",
    )
    nodes = written(
        back.groupBy("chunk")
        .applyInArrow(_ordered(percent, _pivots(back)), NODES)
        .groupBy("node", "n")
        .agg(F.min(F.struct("before", "prefix", "tokens", "cuts", "bits")).alias("x"))
        .select("node", "n", "x.before", "x.prefix", "x.tokens", "x.cuts", "x.bits"),
        "nodes",
    )
    lines = back.where("kind = 0").select("a", "b", "c")
    rows = written(lines.mapInArrow(_lines, f"_id {kind}, n_shingles bigint, node bigint"), "rows")
    dropped(back)
    posts = written(nodes.mapInArrow(_postings, POSTINGS), "postings")

    seeds = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "n", "pos")).alias(f"l{k}") for k in range(LEADERS)]
    lists = posts.groupBy("token").agg(F.count("*").alias("many"), *seeds).where("many > 1")
    leaders = lists.select("token", F.explode(F.array_distinct(F.array(*[f"l{k}" for k in range(LEADERS)]))).alias("l"))
    leaders = leaders.select(
        "token", F.col("l.node").alias("x2"), F.col("l.n").alias("n2"), F.col("l.pos").alias("p2")
    ).distinct()
    here = posts.select("token", F.col("node").alias("x1"), F.col("n").alias("n1"), F.col("pos").alias("p1"))
    met = here.join(leaders, "token").where((F.col("x1") != F.col("x2")) & _may_link(percent))
    first = written(_pairs(met), "pairs")

    segments = nodes.mapInArrow(_segments, SEGMENTS)
    links = written(verified(first, segments, percent), "links")
    found = written(components(links), "found")

    # pairs between components: lists that hold more than one
    named = posts.join(found, "node", "left").select(
        "token", "node", "n", "pos", F.coalesce("root", "node").alias("root")
    )
    named = written(named, "named")
    mixed = (
        named.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("token")
    )
    open_ = written(named.join(mixed, "token").join(nodes.select("node", "before", "bits"), "node"), "open")

    met = across(open_, percent).where(_differ_little(percent))
    more = _pairs(met).join(first, ["u", "v"], "left_anti")
    again = verified(written(more, "pairs"), segments, percent)
    all_ = written(links.unionAll(again), "links")
    found = written(components(all_), "found")

    sets = rows.where("n_shingles > 0").groupBy("node", "n_shingles").agg(F.min("_id").alias("least"))
    rooted = sets.join(found, "node", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    linked = rooted.where("root is not null")
    lows = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.collect_set("salt").alias("salts"))
    lows = lows.select("root", "component_id", F.explode("salts").alias("salt"))
    alone = rooted.where("root is null").select("node", "n_shingles", F.col("least").alias("component_id"))
    named = linked.join(lows, ["root", "salt"]).select("node", "n_shingles", "component_id").unionAll(alone)
    named = written(named, "classes")
    return (
        rows.where("n_shingles > 0")
        .join(named, ["node", "n_shingles"])
        .select(F.col("_id").alias(id_col), "n_shingles", "component_id")
        .unionAll(rows.where("n_shingles = 0").select(F.col("_id"), "n_shingles", F.col("_id")))
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = SHINGLE
) -> DataFrame:
    """The documents of least id of each class, with their columns as they were.

    Rows without an id cannot be named and stay. Of rows that share the least id
    of a class, one stays.
    """
    names = written(classes(docs, id_col, text_col, percent, width), "names")
    gone = names.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    kept = docs.join(gone, id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    again = written(
        names.where(F.col("component_id") == F.col(id_col)).groupBy(id_col).count().where("count > 1").select(id_col),
        "repeated-ids",
    )
    if again.isEmpty():
        return kept
    rest = kept.join(again, id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    first = kept.join(again, id_col, "left_semi").dropDuplicates([id_col]).select(*[f"`{c}`" for c in docs.columns])
    return rest.unionAll(first)
