"""Repair of conversations: the cheapest edits that make a legal one, as an audit.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`. Rows are
kept, given another role or deleted, and empty rows are inserted, by dynamic
programming over the four states of that pattern. The audit of a state is a
linked node: its last edit and the node before it, so all audits share their
beginnings. A node has its ancestors at powers of two and a rolling hash of its
whole string. Where costs tie, the longest common prefix of two audits is found
by binary lifting over hashes; what the hashes say is verified letter by letter
as far as the two do not share nodes, and a collision is settled by spelling.

Conversations are cut out of one global order of (conversation, turn) that
ranges of Spark split anywhere. One inside a task is repaired there. Of one that
crosses a border, or is long, each piece gives the best audits between all pairs
of states; pieces are then chained (a few rows per conversation), and rendered
and hashed by their chosen pair of states. A conversation may thus be any share
of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findrift.llm.store import batched, parts, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs; the last for a truncated row that stays
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL_ENDS = (START, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")
ROLES = {USER: "user", ASSISTANT: "assistant"}
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # role that a new or changed row takes
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}

PIECE_ROWS = 4096
PIECE_CHARS = 4_000_000
PART_BYTES = 32 << 20
MEMO = 50_000  # short conversations whose edits a worker remembers
SHORT = 64

BASE, MOD = 131, (1 << 61) - 1


class Edits:
    """Audits as linked nodes. Node 0 is the empty audit."""

    def __init__(self, mod: int = MOD):
        self.mod = mod
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[tuple[int, ...]] = [()]  # ancestors 1, 2, 4, ... letters before

    def add(self, node: int, letter: str) -> int:
        new = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % self.mod)
        up, k = [node], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.up.append(tuple(up))
        return new

    def spelled(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _at(self, node: int, depth: int) -> int:
        """The ancestor of that depth."""
        over = self.depth[node] - depth
        while over:
            k = over.bit_length() - 1
            node = self.up[node][k]
            over -= 1 << k
        return node

    def _same(self, x: int, y: int) -> bool:
        """Whether two nodes of one depth spell the same, read as far as they do not share nodes."""
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether audit `a` comes before audit `b` in ASCII order."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self._at(a, depth), self._at(b, depth)
        h, up = self.hash, self.up
        if h[x] == h[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
        else:
            for k in range(len(up[x]) - 1, -1, -1):
                if k < len(up[x]) and h[up[x][k]] != h[up[y][k]]:
                    x, y = up[x][k], up[y][k]
            # parents have one hash: x and y hold the first letters that differ
            if self.letter[x] != self.letter[y] and self._same(up[x][0], up[y][0]):
                return self.letter[x] < self.letter[y]
        return self.spelled(a) < self.spelled(b)


def best_edits(kinds: str, start: int = START, mod: int = MOD) -> list[tuple[int, str] | None]:
    """Cost and audit from `start` to each state over rows of these kinds; None if there is no way.

    A kind is `x` for a row that must go, else the initial s, u, a, or o for
    another role; upper case if the row is truncated.
    """
    edits = Edits(mod)

    def better(old, cost: int, node: int, letter: str):
        """The cheaper of `old` and the edit `letter` after `node`, ties by audit."""
        if old is not None and old[0] < cost:
            return old
        new = (cost, edits.add(node, letter))
        return old if old is not None and old[0] == cost and not edits.less(new[1], old[1]) else new

    def inserted(now: list) -> list:
        now = list(now)
        for s in (START, SYSTEM, ASSISTANT, USER):  # into USER first, then from it
            if now[s] is not None:
                now[AFTER[s]] = better(now[AFTER[s]], now[s][0] + INSERT, now[s][1], "I")
        return now

    now: list = [None] * 4
    now[start] = (0, 0)
    now = inserted(now)
    for kind in kinds:
        then: list = [None] * 4
        stays = kind != "x"
        extra = TRUNCATED if kind.isupper() else 0
        keep = STEPS[kind.lower()] if stays else {}
        for s in range(4):
            if now[s] is None:
                continue
            cost, node = now[s]
            then[s] = better(then[s], cost + DELETE, node, "D")
            if s in keep:
                then[keep[s]] = better(then[keep[s]], cost + KEEP + extra, node, "K")
            if stays:
                then[AFTER[s]] = better(then[AFTER[s]], cost + REROLE + extra, node, "R")
        now = inserted(then)
    return [None if x is None else (x[0], edits.spelled(x[1])) for x in now]


def _chosen(ends) -> tuple[int, str]:
    return min(x for s, x in enumerate(ends) if s in LEGAL_ENDS and x is not None)


def rendered(audit: str, roles: list, texts: list, state: int = START) -> list[str]:
    """`role:text` of the rows that an audit leaves."""
    out, k = [], 0
    for edit in audit:
        if edit == "I":
            state = AFTER[state]
            out.append(f"{ROLES[state]}:")
            continue
        role, text = roles[k], texts[k]
        k += 1
        if edit == "K":
            state = STEPS[role[0]][state]
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = AFTER[state]
            out.append(f"{ROLES[state]}:{text}")
    return out


# numbers of a stretch of rows; `first` and `last` are initials, turns ignore nulls
COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
STATS = COUNTS + ["low", "high", "first", "last"]


class _Stretch:
    """Rows of one conversation in order."""

    def __init__(self):
        self.roles, self.texts, self.kinds, self.size = [], [], [], 0
        self.n = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.first = self.last = None

    def add(self, turn, role: str, text: str, kind: int) -> None:
        """`kind` is 0 for a sound row, 1 blank, 2 duplicate, 3 truncated."""
        initial = role[:1]
        if kind:
            self.n[COUNTS[kind - 1]] += 1
        if self.last is not None:
            self.n["illegal"] += self.last + initial not in LEGAL_PAIRS
        else:
            self.first = initial
        self.last = initial
        if turn is not None:
            self.n["turns"] += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        letter = initial if initial and initial in "sua" else "o"
        gone = kind in (1, 2)
        self.kinds.append("x" if gone else letter.upper() if kind == 3 else letter)
        self.roles.append(role)
        self.texts.append(None if gone else text)  # a row that must go is never written
        self.size += 0 if gone else len(text)

    def stats(self) -> dict:
        return {**self.n, "low": self.low, "high": self.high, "first": self.first, "last": self.last}


def _gaps(s: dict) -> int:
    return 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]


def _merged(a: dict | None, b: dict) -> dict:
    """Numbers of two stretches that follow each other."""
    if a is None:
        return b
    out = {k: a[k] + b[k] for k in COUNTS}
    out["illegal"] += a["last"] + b["first"] not in LEGAL_PAIRS
    if a["high"] is not None and a["high"] == b["low"]:
        out["turns"] -= 1
    out["low"] = b["low"] if a["low"] is None else a["low"]
    out["high"] = a["high"] if b["high"] is None else b["high"]
    out["first"], out["last"] = a["first"], b["last"]
    return out


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_L, _S, _I = pa.int64(), pa.string(), pa.int32()
_STATS = [(c, _L) for c in COUNTS] + [("low", _L), ("high", _L), ("first", _S), ("last", _S)]
_PIECE = [("part", _I), ("no", _I), ("costs", pa.list_(_L)), ("audits", pa.list_(_S)), ("roles", pa.list_(_S)), ("texts", pa.list_(_S))]
_OUT = [("gaps", _L), ("cost", _L), ("audit", _S), ("repaired_sha256", _S)]
_DDL = {_L: "bigint", _S: "string", _I: "int", pa.list_(_L): "array<bigint>", pa.list_(_S): "array<string>", pa.bool_(): "boolean"}


def _ddl(fields: list) -> str:
    return ", ".join(f"`{n}` {_DDL[t]}" for n, t in fields)


def _batch(conv_type: pa.DataType, fields: list, rows: list[dict]) -> pa.RecordBatch:
    cols = [pa.array([r["conv"] for r in rows], conv_type)]
    cols += [pa.array([r.get(n) for r in rows], t) for n, t in fields]
    return pa.RecordBatch.from_arrays(cols, names=["conv", *[n for n, _ in fields]])


_memo: dict[str, tuple[int, str]] = {}


def _repaired(s: _Stretch) -> dict:
    kinds = "".join(s.kinds)
    found = _memo.get(kinds)
    if found is None:
        found = _chosen(best_edits(kinds))
        if len(kinds) <= SHORT and len(_memo) < MEMO:
            _memo[kinds] = found
    cost, audit = found
    lines = "\n".join(rendered(audit, s.roles, s.texts))
    stats = s.stats()
    return {**stats, "gaps": _gaps(stats), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}


def _piece(s: _Stretch) -> dict:
    kinds = "".join(s.kinds)
    ways = [w for start in range(4) for w in best_edits(kinds, start)]
    return {
        **s.stats(), "roles": s.roles, "texts": s.texts,
        "costs": [-1 if w is None else w[0] for w in ways], "audits": [None if w is None else w[1] for w in ways],
    }


FIRST = _STATS + _PIECE + _OUT


def _stretches(batches: Iterator[pa.RecordBatch], piece_rows: int) -> Iterator[pa.RecordBatch]:
    """Whole conversations repaired; pieces of those that cross a border of the task or are long."""
    from pyspark import TaskContext

    part, no, out, held = TaskContext.get().partitionId(), 0, [], 0
    now, conv, whole, kind = None, None, False, None

    def closed(done: bool) -> None:
        nonlocal no, held
        if now is None or not now.kinds:
            return
        if whole and done:
            out.append({"conv": conv, **_repaired(now)})
        else:
            out.append({"conv": conv, "part": part, "no": no, **_piece(now)})
            held += now.size + 16 * len(now.kinds)
            no += 1

    for batch in batches:
        kind = batch.column(0).type
        for c, turn, role, text, m, fault, again in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if now is None or c != conv:
                first = now is None
                closed(True)
                now, conv, whole = _Stretch(), c, not first
            for copy in range(m):
                if len(now.kinds) >= piece_rows or now.size >= PIECE_CHARS:
                    closed(False)
                    now, whole = _Stretch(), False
                now.add(turn, role, text, fault if fault == 1 else 2 if again or copy else fault)
            if held > 4 * PIECE_CHARS or len(out) >= 2000:
                yield _batch(kind, FIRST, out)
                out, held = [], 0
    closed(False)
    if out:
        yield _batch(kind, FIRST, out)


class _Chain:
    """A way over the pieces of a conversation: linked, so that ways share their beginnings."""

    __slots__ = ("before", "piece", "depth", "sent")

    def __init__(self, before, piece, depth):
        self.before, self.piece, self.depth, self.sent = before, piece, depth, False

    def comes_before(self, other: _Chain) -> bool:
        a, b, x, y = self, other, [], []
        while a is not b:
            if a is None or b is not None and b.depth >= a.depth:
                y.append(b.piece[-1])
                b = b.before
            else:
                x.append(a.piece[-1])
                a = a.before
        return "".join(reversed(x)) < "".join(reversed(y))


CHOICE = [("part", _I), ("no", _I), ("s", _I), ("t", _I), ("gaps", _L), *[(c, _L) for c in COUNTS], ("cost", _L)]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pair of states chosen for every piece, and a row of numbers per conversation."""
    out: list[dict] = []
    conv, kind, open_, stats, now = None, None, False, None, []

    def send(way: _Chain | None) -> None:
        """Rows of a way as far as they have not been sent; what is before is common to all ways."""
        while way is not None and not way.sent:
            part, no, s, t, _ = way.piece
            out.append({"conv": conv, "part": part, "no": no, "s": s, "t": t})
            way.sent, way, link = True, way.before, way
            link.before = None

    def closed() -> None:
        if not open_:
            return
        best = None
        for s in LEGAL_ENDS:
            x = now[s]
            if x and (best is None or x[0] < best[0] or x[0] == best[0] and x[1].comes_before(best[1])):
                best = x
        send(best[1])
        out.append({"conv": conv, **{k: stats[k] for k in COUNTS}, "gaps": _gaps(stats), "cost": best[0]})

    for batch in batches:
        kind = batch.column(0).type
        names = batch.schema.names[1:]
        for c, *values in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            r = dict(zip(names, values, strict=True))
            if not open_ or c != conv:
                closed()
                conv, open_, stats, now = c, True, None, [(0, None), None, None, None]
            stats = _merged(stats, {k: r[k] for k in STATS})
            then: list = [None] * 4
            for s in range(4):
                for t in range(4):
                    cost = r["costs"][4 * s + t]
                    if now[s] is None or cost < 0:
                        continue
                    before = now[s][1]
                    way = _Chain(before, (r["part"], r["no"], s, t, r["audits"][4 * s + t]), 1 + (before.depth if before else 0))
                    new, old = (now[s][0] + cost, way), then[t]
                    if old is None or new[0] < old[0] or new[0] == old[0] and way.comes_before(old[1]):
                        then[t] = new
            now = then
            common = {id(x[1].before): x[1].before for x in now if x}
            if len(common) == 1:
                send(*common.values())
            if len(out) >= 4096:
                yield _batch(kind, CHOICE, out)
                out.clear()
    closed()
    if out:
        yield _batch(kind, CHOICE, out)


def _written_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text and audit of every piece by its chosen states."""
    for batch in batches:
        rows = []
        for conv, part, no, roles, texts, audits, s, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            audit = audits[4 * s + t]
            lines = rendered(audit, roles, texts, s)
            rows.append({"conv": conv, "part": part, "no": no, "audit": audit, "lines": "\n".join(lines) if lines else None})
        yield _batch(batch.column(0).type, [("part", _I), ("no", _I), ("audit", _S), ("lines", _S)], rows)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of every conversation from its pieces in order; texts are passed, not held."""
    out: list[dict] = []
    conv, kind, sha, audit, some = None, None, None, [], False

    def closed() -> None:
        if sha is not None:
            out.append({"conv": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})

    fields = [("audit", _S), ("repaired_sha256", _S)]
    for batch in batches:
        kind = batch.column(0).type
        for c, a, lines in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if sha is None or c != conv:
                closed()
                conv, sha, audit, some = c, hashlib.sha256(), [], False
            audit.append(a)
            if lines is not None:
                sha.update(("\n" + lines if some else lines).encode())
                some = True
        if len(out) >= 2000:
            yield _batch(kind, fields, out)
            out.clear()
    closed()
    if out:
        yield _batch(kind, fields, out)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by the checksum of `conv_id:turn`; null role and text are one space.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes its end marks,
    3 repeats it, 4 makes it the user's. A null in the key is one space.
    """
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    k = F.crc32(F.concat_ws(":", *named)) % 20
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("`role`").cast("string"), F.lit(" "))
    copies = F.when(k == 0, F.array().cast("array<int>")).when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        F.col("`conv_id`").alias("conv_id"), F.col("`turn`").cast("bigint").alias("turn"),
        F.when(k == 4, "user").otherwise(role).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _not_blank(c: Column) -> Column:
    return c.rlike(r"[^\x20\x09-\x0D]")


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    `rows` has conv_id, turn, role, text; other columns are ignored. Null role
    and text are one space, a null turn comes first, null conv_ids are one
    conversation. Rows of one turn come by role, then by a digest of the text; a
    repeated row is a duplicate. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    batched(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    space = F.lit(" ")
    given = rows.select(
        F.col("`conv_id`").alias("conv"), F.col("`turn`").cast("bigint").alias("turn"),
        F.coalesce(F.col("`role`").cast("string"), space).alias("role"),
        F.coalesce(F.col("`text`").cast("string"), space).alias("text"),
    )
    fault = F.when(~_not_blank(F.col("text")), 1).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    # equal rows are one row with a count, before anything is sorted
    turns = written(
        given.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("m"))
        .withColumn("fault", fault).withColumn("digest", digest),
        "turns",
    )
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    # what is said in several turns: where it is said first
    first = (
        turns.where(F.col("fault") != 1).groupBy("conv", "digest")
        .agg(F.min(place).alias("begins"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        .select(F.col("conv").alias("_c"), F.col("digest").alias("_d"), "begins")
    )
    again = F.coalesce(place > F.col("begins"), F.lit(False)) & (F.col("fault") != 1)
    told = turns.join(first, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")), "left")
    size = turns.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(parts(spark), -(-int(size) // PART_BYTES))
    order = ["conv", "turn", "role", "digest"]
    laid = (
        told.select("conv", "turn", "role", "text", "m", "fault", again.alias("again"), "digest")
        .repartitionByRange(n, *order).sortWithinPartitions(*order).drop("digest")
    )
    done = written(laid.mapInArrow(lambda batches: _stretches(batches, piece_rows), f"conv {kind}, {_ddl(FIRST)}"), "stretches")
    pieces = done.where(F.col("part").isNotNull())
    chosen = written(
        pieces.select("conv", "part", "no", *STATS, "costs", "audits").repartition("conv")
        .sortWithinPartitions("conv", "part", "no").mapInArrow(_chained, f"conv {kind}, {_ddl(CHOICE)}"),
        "choices",
    )
    picked = chosen.where(F.col("part").isNotNull()).select("part", "no", "s", "t")
    texts = (
        pieces.join(picked, ["part", "no"]).select("conv", "part", "no", "roles", "texts", "audits", "s", "t")
        .mapInArrow(_written_out, f"conv {kind}, part int, no int, audit string, lines string")
        .repartition("conv").sortWithinPartitions("conv", "part", "no")
        .select("conv", "audit", "lines").mapInArrow(_hashed, f"_c {kind}, audit string, repaired_sha256 string")
    )
    crossing = chosen.where(F.col("part").isNull()).join(texts, F.col("conv").eqNullSafe(F.col("_c")))
    return done.where(F.col("part").isNull()).select("conv", *RESULT).unionByName(
        crossing.select("conv", *RESULT)
    ).withColumnRenamed("conv", "conv_id")


def audit_damaged(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """`repair` of the damaged rows, with a row for every original conversation."""
    found = repair(damage(rows), piece_rows).withColumnRenamed("conv_id", "_c")
    every = rows.select(F.col("`conv_id`").alias("conv_id")).distinct()
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(empty.get(c, 0)).cast("string" if c in empty else "bigint")).alias(c) for c in RESULT]
    )
