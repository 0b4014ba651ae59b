"""Cost-balanced packing of token sequences.

The cost of a piece is linear in its tokens plus quadratic for attention inside
it. Full-length pieces of long documents are sequences of their own. What is
left of each document goes, longest first, to the open sequence of least cost
that still has room; where none has room, the piece is cut to fill the emptiest
ones. The number of open sequences is the number of tokens over the length, so
all but the last sequence of a block end up full.

Documents are dealt to blocks of a bounded number of tokens by hash. A block is
packed by one task, and costs level out inside it, so work and memory per task
do not depend on the size of the table.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.llm.pieces import PieceEncoder
from findrift.llm.store import batched, written

LENGTH = 2048
END = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024  # of a token, of a pair of tokens inside a piece
BLOCK_TOKENS = 4_000_000
STRETCHES = 200_000  # stretches of text whose ids a worker keeps
FULL = 1 << 62  # numbers of sequences that are one full piece start here

def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


_encoders: dict[str, PieceEncoder] = {}


def _four(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a byte-level tokenizer file whose ids follow its merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # the file writes bytes as printable characters: themselves where printable, else from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocabulary, ranks = model["vocab"], {}
    for c, b in byte.items():
        ranks[bytes([b])] = vocabulary[c]
    for k, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if vocabulary[left + right] != 256 + k:
            raise ValueError("ids of the tokenizer file do not follow its merges")
        ranks[bytes(byte[c] for c in left + right)] = 256 + k
    return ranks


def encoder(path: str, pattern: str) -> PieceEncoder:
    """Ids of texts by a tokenizer file; words seen before are not encoded again.

    The file's merges are run by `tiktoken`, whose ids are those of `tokenizers`
    (tests compare them) at about a quarter of the time.
    """
    if path not in _encoders:
        import tiktoken

        known = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})
        encode = known.encode_ordinary
        _encoders[path] = PieceEncoder(pattern, lambda texts: [_four(encode(t)) for t in texts], STRETCHES, 0)
    return _encoders[path]


def pack(lengths: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(item, start, size, sequence, offset) for items of at most `length` tokens each.

    Items come longest first, ties in their given order. Every token is in
    exactly one piece; offsets are gapless; only the last sequence has room left.
    """
    total = int(lengths.sum())
    count = -(-total // length)
    room = [length] * count
    if total:  # the last sequence takes what the full ones leave
        room[-1] = total - (count - 1) * length
    used = [0] * count
    heap = [(0.0, s) for s in range(count)]  # (cost, sequence) of those with room for the present size
    tight: list[tuple[int, float, int]] = []  # (-room, cost, sequence) of the others
    todo = [(-int(n), k, 0) for k, n in enumerate(lengths) if n]  # (-size, item, start); sizes only fall
    heapify(todo)
    out = []
    while todo:
        left, item, start = heappop(todo)
        left = -left
        while tight and -tight[0][0] >= left:
            _, spent, s = heappop(tight)
            heappush(heap, (spent, s))
        while heap and room[heap[0][1]] < left:
            spent, s = heappop(heap)
            heappush(tight, (-room[s], spent, s))
        if heap:
            spent, s = heappop(heap)
        else:  # none holds it whole: fill the emptiest; the rest waits for its turn
            _, spent, s = heappop(tight)
        size = min(left, room[s])
        out.append((item, start, size, s, used[s]))
        used[s] += size
        room[s] -= size
        if left > size:
            heappush(todo, (size - left, item, start + size))
        if room[s]:
            heappush(heap, (spent + cost(size), s))
    return out


def tokens(
    docs: DataFrame,
    path: str,
    pattern: str,
    length: int = LENGTH,
    end: int = END,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document its full pieces and its remainder: (_row, id, start, size, doc_tokens, full, ids, crc).

    Ids of a remainder are two bytes each where the vocabulary allows, and are
    carried because a remainder may be cut; a full piece needs its checksum only.
    """
    batched(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"_id {kind}, start bigint, size int, doc_tokens bigint, full boolean, ids binary, crc bigint, _row bigint, seq bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path, pattern)
        part = TaskContext.get().partitionId()
        row, seq = part << 40, FULL | part << 36
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            at, start, size, n, full, ids, crc, rows, seqs = [], [], [], [], [], [], [], [], []
            for i, x in enumerate(encode(batch.column(1).to_pylist())):
                x += last
                m = len(x) // 4
                for s in range(0, m, length):
                    piece = x[4 * s : 4 * (s + length)]
                    whole = len(piece) == 4 * length
                    at.append(i)
                    start.append(s)
                    size.append(len(piece) // 4)
                    n.append(m)
                    full.append(whole)
                    crc.append(zlib.crc32(piece))
                    ids.append(None if whole else piece)
                    rows.append(row + i)
                    seqs.append(seq)
                    seq += whole
            row += len(batch)
            for lo in range(0, len(at), 4096):
                cut = slice(lo, lo + 4096)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at[cut], pa.int64())),
                        pa.array(start[cut], pa.int64()),
                        pa.array(size[cut], pa.int32()),
                        pa.array(n[cut], pa.int64()),
                        pa.array(full[cut]),
                        pa.array([None if b is None else _short(b) for b in ids[cut]], pa.binary()),
                        pa.array(crc[cut], pa.int64()),
                        pa.array(rows[cut], pa.int64()),
                        pa.array(seqs[cut], pa.int64()),
                    ],
                    names=["_id", "start", "size", "doc_tokens", "full", "ids", "crc", "_row", "seq"],
                )

    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def _short(ids: bytes) -> bytes:
    """A mark and the ids: two bytes each if all are below 65,536, else four."""
    x = np.frombuffer(ids, "<u4")
    return b"\x02" + x.astype("<u2").tobytes() if not len(x) or x.max() < 1 << 16 else b"\x04" + ids


def _long(ids: bytes) -> bytes:
    return np.frombuffer(ids[1:], "<u2").astype("<u4").tobytes() if ids[:1] == b"\x02" else ids[1:]


def sequences(
    docs: DataFrame,
    path: str,
    pattern: str,
    length: int = LENGTH,
    end: int = END,
    block_tokens: int = BLOCK_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost): one row per piece.

    Null text is empty and is the one end token. A repeated row is a document of
    its own; a null id stays null. Only one sequence per block of about
    `block_tokens` tokens is not full. An empty table gives an empty result.
    `cost` is the estimated cost of the piece.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    made = written(tokens(docs, path, pattern, length, end, id_col, text_col), "pieces")
    rest = made.where("not full")
    n = int(rest.agg(F.sum("size")).first()[0] or 0)
    blocks = max(1, -(-n // block_tokens))
    price = F.lit(LINEAR) * F.col("length") + F.lit(QUADRATIC) * F.col("length") * F.col("length")
    names = f"_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def fill(block: pa.Table) -> pa.Table:
        block = block.sort_by([("size", "descending"), ("_row", "ascending")])
        b = block.column("block")[0].as_py()
        size = np.asarray(block.column("size").to_numpy(), np.int64)
        ids = block.column("ids").to_pylist()
        found = pack(size, length)
        item = np.array([f[0] for f in found], np.int64)
        begin = np.asarray(block.column("start").to_numpy(), np.int64)
        crc = [
            zlib.crc32(_long(ids[i])[4 * s : 4 * (s + z)]) for i, s, z, _, _ in found
        ]
        return pa.table(
            {
                "_id": block.column("_id").take(pa.array(item)),
                "start": pa.array(begin[item] + np.array([f[1] for f in found], np.int64)),
                "length": pa.array([f[2] for f in found], pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": block.column("doc_tokens").take(pa.array(item)),
                "sequence_id": pa.array([(b << 32) + f[3] for f in found], pa.int64()),
                "offset": pa.array([f[4] for f in found], pa.int64()),
            }
        )

    packed = (
        rest.withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
        .groupBy("block")
        .applyInArrow(fill, names)
    )
    whole = made.where("full").select(
        "_id",
        "start",
        F.col("size").cast("bigint").alias("length"),
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        F.col("seq").alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    return packed.unionAll(whole).withColumn("cost", price).withColumnRenamed("_id", id_col)
