"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays.

Training has two counting jobs. Words: each map task adds up its own, packs them
by range of the word's hash, and a reducer per range writes the sorted array of
that range to the shared folder. Bigrams: the same, by range of the first word,
so that what a context needs is added up where its bigrams are; the bigrams of a
word above a fixed share of all tokens (a bounded number of words) are spread
over all ranges by their second word. The model's size follows the corpus.
Scoring: workers map the arrays into memory and look up the sorted hashes of a
batch by binary search; nothing is sent to them and nothing is loaded whole.

Tokens are words (A-Z lower-cased), then one end token per text; a begin mark is
context of the first word only. With c counts, N1, N2, N3+ the successors seen
once, twice and more often:
P(w | v) = (c(v w) - D(c)) / c(v) + (D1 N1(v) + D2 N2(v) + D3 N3+(v)) / c(v) * P(w)
P(w) = the same over the number of different words before w, then 1 / (V + 1).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.llm.store import batched, folder, parts
from findrift.llm.words import U, hashed, mix

FLUSH = 2_500_000  # tokens held by a map task before their counts are sent on
SHARE = 4  # a word with over 1 / (SHARE * ranges) of all tokens is spread: fewer than SHARE * ranges words
BEGIN, END = U(0x42D1B0FA4E1C5A0F), U(0x9C0E1E0FD3B7A6C5)
SHORT = U((1 << 48) - 1)  # bits of a word that a bigram keeps


def joined(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a bigram from the 48-bit hashes of its words."""
    return mix(v * U(0x9E3779B97F4A7C15) + mix(w ^ U(0x5851F42D4C957F2D)))


def sequence(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, the context of each token, and the n + 1 bounds."""
    h, first = hashed(col)
    n = np.diff(first)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    tok = np.empty(bounds[-1], U)
    is_end = np.zeros(bounds[-1], bool)
    is_end[bounds[1:] - 1] = True
    tok[is_end], tok[~is_end] = END, h
    ctx = np.empty_like(tok)
    ctx[1:] = tok[:-1]
    ctx[bounds[:-1]] = BEGIN
    return tok, ctx, bounds


def _six(x: np.ndarray) -> bytes:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _counts(n: np.ndarray) -> bytes:
    """Counts as one byte each where all fit, else eight."""
    return b"\x01" + n.astype(np.uint8).tobytes() if not len(n) or n.max() < 256 else b"\x08" + n.astype("<i8").tobytes()


def _uncounts(b: bytes) -> np.ndarray:
    return np.frombuffer(b[1:], np.uint8 if b[:1] == b"\x01" else "<i8").astype(np.int64)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ascending, their sums, and where each first stood."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(n[order], at) if len(k) else n[:0], order[at]


def _shard(key: np.ndarray, shards: int, shift: int) -> np.ndarray:
    """Range of a hash of 32 + shift bits; ranges ascend with the hash."""
    return ((key >> U(shift)) * U(shards)) >> U(32)


def _pair_shard(v: np.ndarray, w: np.ndarray, spread: np.ndarray, shards: int) -> np.ndarray:
    """Range of a bigram: that of its first word, or of its second if the first is frequent."""
    return _shard(np.where(np.isin(v, spread), w, v), shards, 16)


def _tokens_of(batches, send) -> Iterator[pa.RecordBatch]:
    """Hand the tokens and contexts of at most about FLUSH tokens to `send` at a time."""
    tok, ctx, held = [], [], 0
    for batch in batches:
        t, c, _ = sequence(batch.column(0))
        tok.append(t)
        ctx.append(c)
        held += len(t)
        if held >= FLUSH:
            yield from send(np.concatenate(tok), np.concatenate(ctx))
            tok, ctx, held = [], [], 0
    if held:
        yield from send(np.concatenate(tok), np.concatenate(ctx))


def _rows(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 64):
        cols = zip(*rows[lo : lo + 64], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema
        )


_BIN, _I32 = pa.binary(), pa.int32()
WORDS = pa.schema([("shard", _I32), ("w", _BIN), ("n", _BIN)])
PAIRS = pa.schema([("shard", _I32), ("v", _BIN), ("runs", _BIN), ("w", _BIN), ("n", _BIN)])


def _word_map(shards: int):
    """Map side of words: sorted hashes and counts, packed by range."""

    def send(tok, ctx):
        w, n = np.unique(tok, return_counts=True)
        ends = np.searchsorted(_shard(w, shards, 32), np.arange(shards + 1).astype(U))
        cuts = [(s, slice(ends[s], ends[s + 1])) for s in np.flatnonzero(np.diff(ends)).tolist()]
        yield from _rows([(s, w[c].tobytes(), _counts(n[c])) for s, c in cuts], WORDS)

    return lambda batches: _tokens_of(batches, send)


def _word_reduce(root: str, shards: int):
    """Writes one range of words; returns its size, its sum and words that may be frequent."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        w = np.concatenate([np.frombuffer(b, "<u8") for b in rows.column("w").to_pylist()])
        n = np.concatenate([_uncounts(b) for b in rows.column("n").to_pylist()])
        w, n, _ = _summed(w, n)
        _put(root, f"word-{shard:05d}.key", w.tobytes())
        _put(root, f"word-{shard:05d}.n", _numbers(n[:, None]))
        top = np.flatnonzero(n * SHARE >= n.sum())
        return pa.table({
            "stats": pa.array([[len(w), int(n.sum())]], pa.list_(pa.int64())),
            "words": pa.array([(w[top] & SHORT).astype(np.int64).tolist()], pa.list_(pa.int64())),
            "counts": pa.array([n[top].tolist()], pa.list_(pa.int64())),
        })

    return run


def _pair_map(shards: int, hot: np.ndarray):
    """Map side of bigrams, sorted by context within a range: contexts, run lengths, words, counts."""

    def send(tok, ctx):
        v, w = ctx & SHORT, tok & SHORT
        _, n, at = _summed(joined(v, w), np.ones(len(v), np.int64))
        v, w = v[at], w[at]
        where = _pair_shard(v, w, hot, shards)
        order = np.lexsort((v, where))
        v, w, n, where = v[order], w[order], n[order], where[order]
        ends = np.searchsorted(where, np.arange(shards + 1).astype(U))
        rows = []
        for s in np.flatnonzero(np.diff(ends)).tolist():
            c = slice(ends[s], ends[s + 1])
            u, runs = np.unique(v[c], return_counts=True)
            rows.append((s, _six(u), _counts(runs), _six(w[c]), _counts(n[c])))
        yield from _rows(rows, PAIRS)

    return lambda batches: _tokens_of(batches, send)


PARTIAL = pa.schema(
    [("kind", _I32), ("shard", _I32), ("key", _BIN)]
    + [(f"n{j}", _BIN) for j in range(4)]
    + [("stats", pa.list_(pa.int64()))]
)
PAIR, CONT, CTX = 2, 3, 4


def _pair_reduce(root: str, shards: int):
    """Writes the bigrams of one range; passes on parts of continuation counts and context totals."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        v = np.concatenate([
            np.repeat(_unsix(u), _uncounts(r))
            for u, r in zip(rows.column("v").to_pylist(), rows.column("runs").to_pylist(), strict=True)
        ])
        w = np.concatenate([_unsix(b) for b in rows.column("w").to_pylist()])
        n = np.concatenate([_uncounts(b) for b in rows.column("n").to_pylist()])
        key, n, at = _summed(joined(v, w), n)
        v, w = v[at], w[at]
        _put(root, f"pair-{shard:05d}.key", key.tobytes())
        _put(root, f"pair-{shard:05d}.n", np.minimum(n, 255).astype(np.uint8).tobytes())
        large = np.flatnonzero(n >= 255)
        _put(root, f"pair-{shard:05d}.large", np.stack([large, n[large]]).astype("<i8").tobytes())
        out = [(PAIR, shard, None, None, None, None, None, [len(key)] + [int((n == k).sum()) for k in (1, 2, 3, 4)])]
        u, many = np.unique(w, return_counts=True)
        c, cat = np.unique(v, return_inverse=True)
        total = np.bincount(cat, n, len(c)).astype(np.int64)
        seen = [np.bincount(cat[m], minlength=len(c)) for m in (n == 1, n == 2, n > 2)]
        for kind, k, sums in ((CONT, u, [many]), (CTX, c, [total, *seen])):
            ends = np.searchsorted(_shard(k, shards, 16), np.arange(shards + 1).astype(U))
            for s in np.flatnonzero(np.diff(ends)).tolist():
                cut = slice(ends[s], ends[s + 1])
                blobs = [_counts(x[cut]) for x in sums]
                out.append((kind, s, _six(k[cut]), *blobs, *[None] * (4 - len(blobs)), None))
        cols = zip(*out, strict=True)
        return pa.table([pa.array(x, f.type) for x, f in zip(cols, PARTIAL, strict=True)], schema=PARTIAL)

    return run


def _last_reduce(root: str):
    """Adds up continuation counts or context totals of a range of words, and writes them."""

    def run(rows: pa.Table) -> pa.Table:
        kind, shard = rows.column("kind")[0].as_py(), rows.column("shard")[0].as_py()
        if kind == PAIR:
            stats = rows.column("stats").to_pylist()
        else:
            k = np.concatenate([_unsix(b) for b in rows.column("key").to_pylist()])
            width = 1 if kind == CONT else 4
            sums = []
            for j in range(width):
                n = np.concatenate([_uncounts(b) for b in rows.column(f"n{j}").to_pylist()])
                key, n, _ = _summed(k, n)
                sums.append(n)
            name = "cont" if kind == CONT else "ctx"
            _put(root, f"{name}-{shard:05d}.key", key.astype("<u8").tobytes())
            _put(root, f"{name}-{shard:05d}.n", _numbers(np.stack(sums, axis=1)))
            stats = [[len(key), int(sums[0].sum())] + [int((sums[0] == j).sum()) for j in (1, 2, 3, 4)]]
        return pa.table({
            "kind": pa.array([kind] * len(stats), pa.int32()), "stats": pa.array(stats, pa.list_(pa.int64())),
        })

    return run


def _numbers(n: np.ndarray) -> bytes:
    """Rows of four-byte numbers where all fit, else of eight."""
    return np.ascontiguousarray(n).astype("<u4" if not n.size or n.max() < 1 << 32 else "<u8").tobytes()


def _put(root: str, name: str, data: bytes) -> None:
    """Write a file under another name first, so that a reader never sees half of it."""
    fs, path = pafs.FileSystem.from_uri(f"{root}/{name}")
    tmp = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as f:
        f.write(data)
    fs.move(tmp, path)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; 0.75 where the corpus gives none."""
    if not n1 or not n2:
        return (0.75, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return (min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0))


@dataclass(frozen=True)
class Model:
    """Numbers that hold for the whole model, and the folder of its arrays."""

    root: str
    shards: int
    tokens: int
    distinct: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    pairs: int
    spread: tuple[int, ...]  # frequent words, whose bigrams lie by their second word
    cont_sizes: tuple[int, int, int]  # words with one, two, more different words before them


def _sums(rows: list, kind: int, width: int) -> list[int]:
    out = [0] * width
    for r in rows:
        if r["kind"] == kind:
            out = [a + b for a, b in zip(out, r["stats"], strict=True)]
    return out


def train(docs: DataFrame, text_col: str = "text", shards: int | None = None) -> Model:
    """Count all texts. Null is empty; an empty table gives a model that knows no word.

    `shards` is the number of ranges; by default twice the shuffle partitions,
    so that a range is a small part of what a task can hold.
    """
    spark = docs.sparkSession
    batched(spark)
    shards = shards or 2 * parts(spark)
    root = folder(spark, "lm")
    _make(spark, root)
    text = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    # collected below: a few numbers per range
    counted = (
        text.mapInArrow(_word_map(shards), "shard int, w binary, n binary")
        .groupBy("shard")
        .applyInArrow(_word_reduce(root, shards), "stats array<bigint>, words array<bigint>, counts array<bigint>")
        .collect()
    )
    distinct, tokens = (sum(r["stats"][j] for r in counted) for j in (0, 1))
    hot = [
        w
        for r in counted
        for w, n in zip(r["words"], r["counts"], strict=True)
        if n * SHARE * shards >= tokens
    ]
    hot = np.array([*hot, int(BEGIN & SHORT)], dtype=U)
    rows = (
        text.mapInArrow(_pair_map(shards, hot), "shard int, v binary, runs binary, w binary, n binary")
        .groupBy("shard")
        .applyInArrow(
            _pair_reduce(root, shards),
            "kind int, shard int, key binary, n0 binary, n1 binary, n2 binary, n3 binary, stats array<bigint>",
        )
        .groupBy("kind", "shard")
        .applyInArrow(_last_reduce(root), "kind int, stats array<bigint>")
        .collect()
    )
    pairs, cont = _sums(rows, PAIR, 5), _sums(rows, CONT, 6)
    return Model(
        root, shards, tokens, distinct, discounts(*pairs[1:]), discounts(*cont[2:]), pairs[0],
        tuple(hot.tolist()), (cont[2], cont[3], cont[0] - cont[2] - cont[3]),
    )


def _make(spark: SparkSession, root: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


class Arrays:
    """The sorted arrays of a model, mapped into memory where the folder allows it."""

    def __init__(self, model: Model):
        self.model = model
        self.fs, self.base = pafs.FileSystem.from_uri(model.root)
        self.files: dict[str, np.ndarray] = {}

    def file(self, name: str, kind) -> np.ndarray:
        if name not in self.files:
            path = f"{self.base}/{name}"
            info = self.fs.get_file_info(path)
            if info.type == pafs.FileType.NotFound or not info.size:
                out = np.zeros(0, kind)
            elif isinstance(self.fs, pafs.LocalFileSystem):
                out = np.memmap(path, kind, "r")
            else:  # a store without memory maps: read on demand
                with self.fs.open_input_file(path) as f:
                    out = np.frombuffer(f.read(), kind)
            self.files[name] = out
        return self.files[name]

    def _look(self, table: str, keys: np.ndarray, where: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """Columns of keys sorted by range, then key; 0 where a key is missing."""
        out = [np.zeros(len(keys), np.int64) for _ in range(width)]
        s = self.model.shards
        ends = np.searchsorted(where, np.arange(s + 1).astype(U))
        for k in np.flatnonzero(np.diff(ends)):
            part = keys[ends[k] : ends[k + 1]]
            have = self.file(f"{table}-{k:05d}.key", "<u8")
            if not len(have):
                continue
            at = np.minimum(np.searchsorted(have, part), len(have) - 1)
            hit = np.flatnonzero(have[at] == part)
            at = at[hit]
            if table == "pair":
                n = self.file(f"pair-{k:05d}.n", np.uint8)[at].astype(np.int64)
                if (n == 255).any():
                    large = self.file(f"pair-{k:05d}.large", "<i8").reshape(2, -1)
                    big = n == 255
                    n[big] = large[1][np.searchsorted(large[0], at[big])]
                out[0][ends[k] + hit] = n
            else:
                size = self.file(f"{table}-{k:05d}.n", np.uint8)
                wide = len(size) // (len(have) * width)
                n = size.view("<u4" if wide == 4 else "<u8").reshape(-1, width)[at]
                for j in range(width):
                    out[j][ends[k] + hit] = n[:, j]
        return tuple(out)

    def words(self, w: np.ndarray) -> np.ndarray:
        return self._look("word", w, _shard(w, self.model.shards, 32), 1)[0]

    def scores(self, ctx: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of P(tok | ctx) and the training count of each token."""
        m = self.model
        w, wat = np.unique(tok, return_inverse=True)
        count = self.words(w)
        short, sat = np.unique(w & SHORT, return_inverse=True)
        cont = self._look("cont", short, _shard(short, m.shards, 16), 1)[0][sat]
        base = 1.0 / (m.distinct + 1)
        d = m.word_discounts
        if m.pairs:
            back = (d[0] * m.cont_sizes[0] + d[1] * m.cont_sizes[1] + d[2] * m.cont_sizes[2]) / m.pairs
            low = np.maximum(cont - np.choose(np.minimum(cont, 3), (0.0, *d)), 0) / m.pairs + back * base
        else:
            low = np.full(len(w), base)
        low = low[wat]
        v, vat = np.unique(ctx & SHORT, return_inverse=True)
        total, n1, n2, n3 = self._look("ctx", v, _shard(v, m.shards, 16), 4)
        d = m.pair_discounts
        seen = total > 0
        back = np.ones(len(v))
        back[seen] = ((d[0] * n1 + d[1] * n2 + d[2] * n3)[seen]) / total[seen]
        p, first, pat = np.unique(joined(ctx & SHORT, tok & SHORT), return_index=True, return_inverse=True)
        where = _pair_shard(ctx[first] & SHORT, tok[first] & SHORT, np.array(m.spread, U), m.shards)
        order = np.argsort(where, kind="stable")
        c = np.empty(len(p), np.int64)
        c[order] = self._look("pair", p[order], where[order], 1)[0]
        c = c[pat]
        high = np.maximum(c - np.choose(np.minimum(c, 3), (0.0, *d)), 0) / np.maximum(total[vat], 1)
        return np.log10(high + back[vat] * low), count[wat]


@lru_cache(maxsize=2)
def arrays(model: Model) -> Arrays:
    return Arrays(model)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score, perplexity) of every row.

    Null text is empty: one end token. A null or repeated id is scored like any
    other. Scores are sums of log10 over the tokens.
    """
    batched(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = arrays(model)
        for batch in batches:
            tok, ctx, bounds = sequence(batch.column(1))
            if len(batch) == 0:
                continue
            p, c = a.scores(ctx, tok)
            n = np.diff(bounds)
            at = bounds[:-1]
            base = np.log10(c + 1.0) - _base_log(model)
            total = np.add.reduceat(p, at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.array(np.add.reduceat((c > 0).astype(np.int64), at)),
                    pa.array(np.add.reduceat(base, at)),
                    pa.array(total),
                    pa.array(np.power(10.0, -total / n)),
                ],
                names=[id_col, "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

    return docs.select(id_col, F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(
        run,
        f"`{id_col}` {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double",
    )


def _base_log(model: Model) -> float:
    """log10 of the denominator of the base score."""
    return float(np.log10(model.tokens + 1.0 * (model.distinct + 1)))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % n
