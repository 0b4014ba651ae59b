"""Byte-level BPE by a rank queue over hierarchical bitmaps.

Each merge rank owns a bucket of positions in a linked list of byte runs. A
three-level bitmap (64 ways a level) tells which buckets are not empty; three
find-first-set steps give the lowest rank. A position whose pair no longer has
that rank is stale and skipped. The pre-tokens of a batch share one list and one
queue, with a wall between neighbours, so the bitmap is read once per bucket and
not once per position. Within a rank positions leave leftmost first; when a merge
makes a pair of a lower rank, that bucket comes next. Each pre-token therefore
sees its merges in the usual order. Work is linear in the bytes, so one very long
pre-token is no worse than many short ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from findrift.llm.pieces import PieceEncoder
from findrift.llm.store import batched


class RankQueue:
    """Buckets of positions by rank; the lowest rank that has any comes first."""

    def __init__(self, ranks: int):
        n0 = -(-ranks // 64)
        n1 = -(-n0 // 64)
        if n1 > 64:
            raise ValueError("more ranks than three levels of 64 hold")
        self.buckets: dict[int, list[int]] = {}
        self.low, self.mid, self.top = [0] * n0, [0] * n1, 0

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions, leftmost first."""
        top = self.top
        if not top:
            return None
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        word = self.low[a]
        rank = (a << 6) + (word & -word).bit_length() - 1
        self.low[a] = word = word & (word - 1)
        if not word:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Codec:
    """Encoder and decoder for one vocabulary of byte strings to ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"no rank for {len(missing)} single bytes")
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.double = np.full(1 << 16, -1, np.int64)
        for b, i in ranks.items():
            if len(b) == 2:
                self.double[b[0] << 8 | b[1]] = i
        self.encode = PieceEncoder(pattern, lambda texts: self.merge([t.encode("utf-8") for t in texts]))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers."""
        ranks = self.ranks
        out = [b"" if not p else ranks[p].to_bytes(4, "little") if p in ranks else None for p in pieces]
        todo = [k for k, x in enumerate(out) if x is None]
        if not todo:
            return out
        data = b"".join([pieces[k] for k in todo])
        n = len(data)
        ends = np.cumsum([len(pieces[k]) for k in todo])
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        first = np.full(n, -1, np.int64)
        first[:-1] = self.double[raw[:-1] << 8 | raw[1:]]
        first[ends - 1] = -1
        wall = bytearray(n + 1)  # 1 where a pre-token starts, and at the end
        wall[0] = 1
        for e in ends.tolist():
            wall[e] = 1
        token = self.single[raw].tolist()
        pair = first.tolist()  # rank of the run at i with the next one, else -1
        after, before = list(range(1, n + 1)), list(range(-1, n))
        queue, get = self.queue, ranks.get
        buckets = queue.buckets
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        at = np.flatnonzero(np.diff(first[order], prepend=-1))
        for positions in np.split(order, at[1:]) if len(order) else ():
            queue.push(pair[positions[0]], positions.tolist())
        while (found := queue.pop()) is not None:
            rank, bucket = found
            for turn, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale: the run was merged into another or has grown
                token[i] = rank
                j = after[i]
                k = after[i] = after[j]
                pair[i] = pair[j] = -1
                least = rank
                if not wall[k]:
                    before[k] = i
                    r = get(data[i : after[k]])
                    if r is not None:
                        pair[i] = r
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            queue.push(r, [i])
                        least = r
                if not wall[i]:
                    h = before[i]
                    r = get(data[h:k])
                    if r is None:
                        pair[h] = -1
                    else:
                        pair[h] = r
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            queue.push(r, [h])
                        if r < least:
                            least = r
                if least < rank:  # that bucket comes first
                    if turn + 1 < len(bucket):
                        queue.push(rank, bucket[turn + 1 :])
                    break
        runs, i = [], 0
        while i < n:
            runs.append(i)
            i = after[i]
        ids = np.array(token, "<u4")[runs]
        cuts = np.searchsorted(runs, ends)
        start = 0
        for k, cut in zip(todo, cuts.tolist(), strict=True):
            out[k] = ids[start:cut].tobytes()
            start = cut
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of this worker process; its cache outlives a task."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, ids binary, n_tokens, decoded binary): ids and the bytes decoded from them.

    One narrow pass: no shuffle, batches stream through. Null text is empty and
    has no tokens; a null or repeated id stays as it is; other columns are not
    read. `path` names a vocabulary file that every worker can open.
    """
    batched(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids = c.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(ids, pa.binary()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([c.decode(x) for x in ids], pa.binary()),
                ],
                names=[id_col, "ids", "n_tokens", "decoded"],
            )

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, ids binary, n_tokens bigint, decoded binary"
    )


def digests(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of `encode`, hashed where the ids are made."""
    batched(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            counts, one, two = [], [], []
            for ids in c.encode(batch.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(one), pa.array(two)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
