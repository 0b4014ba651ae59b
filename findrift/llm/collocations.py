"""Phrases whose words occur together far more often than alone, per language.

Level by level, as Apriori allows: only words seen MIN_COUNT times can be in a
phrase, and only pairs seen as often in a triple. Each level first sieves what the
texts hold (counts stop at the support, so they only say "enough"), then builds
double-array tries of what is left. A trie is a shard of the candidates, by hash
of the first two words, of bounded size, so it may be broadcast. Workers advance
the states of all positions of a text block together, one digit of a word's code
at a time, and count accepting states by `bincount`; the sums over blocks and
shards are the exact counts that the scores use. Where there are several tries,
the positions are dealt to them once, as windows of three codes, so that a trie's
pass reads its own windows only and all passes together read the corpus once.

Texts become blocks of word codes once. A code is the place of the word's hash
in the sorted hash arrays of all frequent words, which workers map into memory;
-1 stands for a word that is not frequent and for every border of a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findrift.llm.kneser_ney import _put
from findrift.llm.store import batched, dropped, folder, parts, written
from findrift.llm.words import U, mix, text_bytes, word_hashes

MIN_COUNT = 10
LONGEST = 3
TOP = 2000
SCALE = 1_000_000
KEPT_SHARE = 50  # a phrase goes if a longer one has this share, in percent, of its count
BLOCK = 500_000  # words of a block of codes
RANGE = 4_000_000  # words of the corpus per range of a sieve
TRIE = 300_000  # phrases of a trie, about
LEXICON = 1_000_000  # words of a file of the lexicon, about
DEALT = 1_000_000  # bytes of a file of windows, about
HELD = 16_000_000  # bytes of windows that a task holds before it hands them on
UNKNOWN = "und"

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLANK = _BREAK.copy()
_BLANK[[0x20, 0x09]] = True


def tokens(col) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start and end of every word, the text it is in, and whether a piece starts with it."""
    data, offs = text_bytes(col)
    inside = ~_BLANK[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    some = offs[:-1] < offs[1:]
    first, last = offs[:-1][some], offs[1:][some] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    text = np.searchsorted(offs, starts, "right") - 1
    breaks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_BREAK[data], out=breaks[1:])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]])
    return data, starts, ends, text, fresh


def _lang_hash(names: list[str]) -> np.ndarray:
    """A hash for each of the names; few names are computed, the rest repeated."""
    known = {n: i for i, n in enumerate(dict.fromkeys(names))}
    data, offs = text_bytes(pa.array(list(known), pa.string()))
    return word_hashes(data, offs[:-1], offs[1:])[[known[n] for n in names]] if names else np.zeros(0, U)


def _keys(hashes: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """64-bit key of a word in a language."""
    return mix(hashes * U(0x9E3779B97F4A7C15) + mix(langs))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of every batch, each word of a language once."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, starts, ends, text, _ = tokens(batch.column(1))
        if not len(starts):
            continue
        key = _keys(word_hashes(data, starts, ends), _lang_hash(langs)[text])
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        raw = data.tobytes()
        spans = zip(starts[at].tolist(), ends[at].tolist(), strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([langs[t] for t in text[at].tolist()], pa.string()),
                pa.array([raw[s:e].lower().decode() for s, e in spans], pa.string()),
                pa.array(n.astype(np.int64)),
            ],
            names=["lang", "word", "n"],
        )


def _lexicon_writer(root: str) -> Callable[[pa.Table], pa.Table]:
    """Sorts one range of keys into a file; gives each word its place there."""

    def run(rows: pa.Table) -> pa.Table:
        key = rows.column("key").to_numpy().view(U)
        order = np.argsort(key)
        key = key[order]
        if (key[1:] == key[:-1]).any():
            raise ValueError("two words of a language share a hash")
        _put(root, f"words-{rows.column('shard')[0].as_py():05d}", key.astype("<u8").tobytes())
        rows = rows.take(pa.array(order))
        return rows.select(["shard", "lang", "word", "f"]).append_column("place", pa.array(np.arange(len(key), dtype=np.int64)))

    return run


@dataclass(frozen=True)
class Lexicon:
    """Where the sorted keys of frequent words lie; `bases` has the code of each file's first word, and the end."""

    root: str
    bases: tuple[int, ...]

    def codes(self, key: np.ndarray) -> np.ndarray:
        """Code of each key, -1 for words that are not frequent."""
        out = np.full(len(key), -1, np.int32)
        shards = len(self.bases) - 1
        distinct, back = np.unique(key, return_inverse=True)
        found = np.full(len(distinct), -1, np.int32)
        ends = np.searchsorted(_range(distinct, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(ends)).tolist():
            known = _mapped(self.root, f"words-{s:05d}")
            if len(known):
                k = distinct[ends[s] : ends[s + 1]]
                at = np.minimum(np.searchsorted(known, k), len(known) - 1)
                found[ends[s] : ends[s + 1]] = np.where(known[at] == k, at + self.bases[s], -1)
        out[:] = found[back]
        return out


_maps: dict[str, np.ndarray] = {}


def _mapped(root: str, name: str) -> np.ndarray:
    """A file of 64-bit numbers, mapped into memory where the store allows; an absent one is empty."""
    at = f"{root}/{name}"
    if at not in _maps:
        fs, path = pafs.FileSystem.from_uri(at)
        if fs.get_file_info(path).type != pafs.FileType.File:
            _maps[at] = np.zeros(0, "<u8")
        elif isinstance(fs, pafs.LocalFileSystem):
            _maps[at] = np.memmap(path, "<u8", "r")
        else:
            with fs.open_input_file(path) as f:
                _maps[at] = np.frombuffer(f.read(), "<u8")
    return _maps[at]


def _range(key: np.ndarray, n: int) -> np.ndarray:
    """Range of a 64-bit key; ranges ascend with the key."""
    return (((key >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def _blocks(lexicon: Lexicon) -> Callable:
    """Blocks of about BLOCK codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, starts, ends, text, fresh = tokens(batch.column(1))
            langs = _lang_hash(batch.column(0).to_pylist())
            code = lexicon.codes(_keys(word_hashes(data, starts, ends), langs[text]))
            at = np.arange(len(code)) + np.cumsum(fresh)
            out = np.full(len(code) + int(fresh.sum()), -1, np.int32)
            out[at] = code
            # one border is as good as many
            keep = np.ones(len(out), bool)
            keep[1:] = (out[1:] >= 0) | (out[:-1] >= 0)
            held.append(out[keep])
            size += len(held[-1])
            if size >= BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["codes"])
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["codes"])

    return run


def _codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The blocks, each with borders behind it so that windows may run over its end."""
    for batch in batches:
        for b in batch.column(0):
            yield np.concatenate([np.frombuffer(b.as_buffer(), "<i4"), np.full(LONGEST, -1, np.int32)])


def _packed(key: np.ndarray, ranges: int, support: int) -> Iterator[pa.RecordBatch]:
    """Distinct keys with their counts, up to the support, packed by range."""
    key, n = np.unique(key, return_counts=True)
    where = _range(mix(key), ranges)
    order = np.argsort(where, kind="stable")
    key, n, where = key[order], np.minimum(n, min(support, 255)).astype(np.uint8)[order], where[order]
    ends = np.searchsorted(where, np.arange(ranges + 1))
    some = np.flatnonzero(np.diff(ends)).tolist()
    for lo in range(0, len(some), 64):
        cuts = [slice(ends[r], ends[r + 1]) for r in some[lo : lo + 64]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some[lo : lo + 64], pa.int32()),
                pa.array([key[c].tobytes() for c in cuts], pa.binary()),
                pa.array([n[c].tobytes() for c in cuts], pa.binary()),
            ],
            names=["range", "key", "n"],
        )


def _enough(support: int, *by: str) -> Callable[[pa.Table], pa.Table]:
    """Keys of one range that reach the support."""

    def run(rows: pa.Table) -> pa.Table:
        key = np.concatenate([np.frombuffer(b, "<u8") for b in rows.column("key").to_pylist()])
        n = np.concatenate([np.frombuffer(b, np.uint8) for b in rows.column("n").to_pylist()])
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key = key[at][np.add.reduceat(n, at) >= min(support, 255)]
        out = {"high": pa.array((key >> U(32)).astype(np.int64)), "low": pa.array((key & U(0xFFFFFFFF)).astype(np.int64))}
        return pa.table(out | {c: pa.array(np.full(len(key), rows.column(c)[0].as_py(), np.int32)) for c in by})

    return run


def _sieved(keys: DataFrame, support: int, *by: str) -> DataFrame:
    """Keys (high, low) that reach the support, within each value of the columns `by`."""
    schema = ", ".join(["high bigint", "low bigint", *(f"{c} int" for c in by)])
    return keys.groupBy(*by, "range").applyInArrow(_enough(support, *by), schema)


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(U) << U(32)) | low.astype(U)


def _pair_keys(ranges: int, support: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _codes_of(batches):
            both = np.flatnonzero((c[:-1] >= 0) & (c[1:] >= 0))
            yield from _packed(_joined(c[both], c[both + 1]), ranges, support)

    return run


def build_trie(phrases: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double array of phrases of two or three codes (-1 for no third): base, check, and the state of each phrase.

    A code is `digits` bytes. State 0 is the root; the child of state s by byte
    d is base[s] + d, if check there is s. States with several children are
    placed where all their places are free, largest first; the others then fill
    the gaps at once.
    """
    n = len(phrases)
    word = [np.maximum(phrases[:, j], 0) for j in range(3)]
    syms = np.stack(
        [(w >> (8 * (digits - 1 - d))) & 255 for w in word for d in range(digits)], axis=1
    ).astype(np.int64)
    depth = np.where(phrases[:, 2] >= 0, 3 * digits, 2 * digits)
    base, check, used = (np.zeros(1024, np.int64) for _ in range(3))
    check -= 1
    used = used.astype(bool)
    used[0] = True
    top = 1
    state = np.zeros(n, np.int64)
    for level in range(3 * digits):
        alive = np.flatnonzero(depth > level)
        if not len(alive):
            break
        edge, back = np.unique(state[alive] * 256 + syms[alive, level], return_inverse=True)
        parent, sym = edge >> 8, edge & 255
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        many = np.diff(np.append(first, len(edge)))
        need = top + len(edge) + 256 * (int((many > 1).sum()) + 2)
        if need > len(base):
            more = need - len(base)
            base = np.concatenate([base, np.zeros(more, np.int64)])
            check = np.concatenate([check, np.full(more, -1, np.int64)])
            used = np.concatenate([used, np.zeros(more, bool)])
        place = np.zeros(len(edge), np.int64)
        cursor = 1
        for g in np.argsort(-many, kind="stable"):
            if many[g] < 2:
                break
            children = sym[first[g] : first[g] + many[g]]
            free = np.flatnonzero(~used[cursor : cursor + 2048]) + cursor
            if len(free) < 128:
                cursor += 1024
            tries = free[:48] - children[0]
            tries = tries[tries >= 0]
            fits = ~used[tries[:, None] + children].any(axis=1)
            b = int(tries[fits.argmax()]) if fits.any() else max(top - int(children[0]), 0)
            spots = b + children
            used[spots] = True
            top = max(top, int(spots[-1]) + 1)
            place[first[g] : first[g] + many[g]] = spots
            base[parent[first[g]]] = b
        lone = first[many == 1]
        if len(lone):
            free = np.flatnonzero(~used[256 : top + len(lone) + 256])[: len(lone)] + 256
            place[lone] = free
            used[free] = True
            base[parent[lone]] = free - sym[lone]
            top = max(top, int(free[-1]) + 1)
        check[place] = parent
        state[alive] = place[back.reshape(-1)]
    size = top + 256
    return base[:size].astype(np.int32), check[:size].astype(np.int32), state


def advance(
    c: np.ndarray, base: np.ndarray, check: np.ndarray, digits: int, words: int, at: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... words from every position, or those in `at`: the positions still on a path, and their states."""
    at = np.flatnonzero(c[: len(c) - LONGEST] >= 0) if at is None else at
    state = np.zeros(len(at), np.int32)
    for w in range(words):
        code = c[at + w]
        on = code >= 0
        at, state, code = at[on], state[on], code[on]
        for d in range(digits):
            step = base[state] + ((code >> (8 * (digits - 1 - d))) & 255)
            on = check[step] == state
            at, state, code = at[on], step[on], code[on]
        yield at, state


def _builder(digits: int) -> Callable[[pa.Table], pa.Table]:
    """One trie as a row of its arrays, and a row for each phrase and its state."""

    def run(rows: pa.Table) -> pa.Table:
        phrases = np.stack([rows.column(f"c{j}").to_numpy() for j in (1, 2, 3)], axis=1).astype(np.int64)
        base, check, state = build_trie(phrases, digits)
        n, whole = len(phrases), pa.nulls(1, pa.int64())
        numbers = [pa.concat_arrays([pa.array(x), whole]) for x in (state, *(np.ascontiguousarray(phrases[:, j]) for j in range(3)))]
        none = pa.nulls(n, pa.binary())
        arrays = [pa.concat_arrays([none, pa.array([x.tobytes()], pa.binary())]) for x in (base, check)]
        shard = pa.array(np.full(n + 1, rows.column("shard")[0].as_py(), np.int32))
        return pa.table([shard, *numbers, *arrays], names=["shard", "state", "c1", "c2", "c3", "base", "check"])

    return run


TRIES = "shard int, state bigint, c1 bigint, c2 bigint, c3 bigint, base binary, check binary"


def _shard(first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    """The trie that holds the phrases which begin with two codes."""
    return _range(mix(_joined(first, second)), shards).astype(np.int32)


def _sharded(shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (batch.column(j).to_numpy() for j in (0, 1))
            yield batch.append_column("shard", pa.array(_shard(first, second, shards)))

    return run


def _tries(phrases: DataFrame, digits: int, trie_phrases: int) -> tuple[DataFrame, int]:
    """Tries of the stored phrases (c1, c2, c3), and how many; a trie holds about `trie_phrases`."""
    shards = max(1, -(-phrases.count() // trie_phrases))
    split = phrases.select("c1", "c2", "c3").mapInArrow(_sharded(shards), "c1 bigint, c2 bigint, c3 bigint, shard int")
    built = split.groupBy("shard").applyInArrow(_builder(digits), TRIES)
    return written(built, "tries"), shards


def _windows(shards: int) -> Callable:
    """(shard, codes): from every position with two frequent words its three codes, by the trie of the first two."""

    def handed(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for shard, pieces in enumerate(held):
            for lo in range(0, len(pieces), 64):
                codes = np.concatenate(pieces[lo : lo + 64])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([codes.tobytes()], pa.binary())], names=["shard", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[] for _ in range(shards)], 0
        for c in _codes_of(batches):
            at = np.flatnonzero((c[:-2] >= 0) & (c[1:-1] >= 0))
            shard = _shard(c[at], c[at + 1], shards)
            order = np.argsort(shard, kind="stable")
            at, ends = at[order], np.searchsorted(shard[order], np.arange(shards + 1))
            codes = np.stack([c[at], c[at + 1], c[at + 2]], axis=1).ravel()
            for s in np.flatnonzero(np.diff(ends)).tolist():
                held[s].append(codes[3 * ends[s] : 3 * ends[s + 1]].copy())
            size += codes.nbytes
            if size >= HELD:
                yield from handed(held)
                held, size = [[] for _ in range(shards)], 0
        yield from handed(held)

    return run


def _dealt(blocks: DataFrame, shards: int, total: int) -> DataFrame:
    """The windows of all blocks, a folder per trie; no file is much smaller than DEALT, whatever the number of tries."""
    root = folder(blocks.sparkSession, "windows")
    files = max(parts(blocks.sparkSession), 12 * total // (shards * DEALT))
    dealt = blocks.coalesce(files).mapInArrow(_windows(shards), "shard int, codes binary")
    dealt.write.partitionBy("shard").parquet(root)
    return blocks.sparkSession.read.schema("codes binary, shard int").parquet(root)


def _over_tries(
    blocks: DataFrame, tries: DataFrame, shards: int, total: int, use: Callable, schema: str
) -> DataFrame | None:
    """`use(shard, trie)` over the windows of every trie, or the blocks if it is the only one; one is broadcast at a time."""
    spark = blocks.sparkSession
    dealt = _dealt(blocks, shards, total) if shards > 1 else None
    done = []
    for shard in range(shards):
        row = tries.where((F.col("shard") == shard) & F.col("base").isNotNull()).select("base", "check").first()
        if row is None:
            continue
        sent = spark.sparkContext.broadcast((row.base, row.check))  # bounded by the phrases of a trie
        del row
        own = blocks if dealt is None else dealt.where(F.col("shard") == shard).select("codes")
        done.append(folder(spark, "trie-pass"))
        own.mapInArrow(use(shard, sent), schema).write.parquet(done[-1])
        sent.destroy()  # the driver's copies too: what was written needs no trie again
    if dealt is not None:
        dropped(dealt, 2)
    return spark.read.schema(schema).parquet(*done) if done else None


def _starts(c: np.ndarray, shards: int) -> np.ndarray | None:
    """Where windows begin; None for blocks, whose every position may."""
    return np.arange(0, len(c) - LONGEST, 3) if shards > 1 else None


def _arrays(sent) -> tuple[np.ndarray, np.ndarray]:
    base, check = sent.value
    return np.frombuffer(base, np.int32), np.frombuffer(check, np.int32)


def _triple_keys(ranges: int, support: int, digits: int, shards: int) -> Callable:
    """Keys (state of the first pair, third word) where both pairs of a triple are frequent.

    A second pair that another trie may hold is let through; the sieve decides.
    """

    def use(shard: int, sent) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, check = _arrays(sent)
            for c in _codes_of(batches):
                for at, state in advance(c, base, check, digits, 2, _starts(c, shards)):
                    pass
                if shards == 1:
                    seen = np.zeros(len(c), bool)
                    seen[at] = True
                    ok = seen[at + 1]
                else:
                    ok = c[at + 2] >= 0
                for batch in _packed(_joined(state[ok], c[at[ok] + 2]), ranges, support):
                    yield batch.append_column("shard", pa.array(np.full(len(batch), shard, np.int32)))

        return run

    return use


def _state_counts(digits: int, shards: int) -> Callable:
    """Occurrences of every accepting state of a trie in a task's blocks."""

    def use(shard: int, sent) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, check = _arrays(sent)
            total = np.zeros(len(base), np.int64)
            for c in _codes_of(batches):
                for words, (_, state) in enumerate(advance(c, base, check, digits, LONGEST, _starts(c, shards)), 1):
                    if words > 1:
                        total += np.bincount(state, minlength=len(total))
            state = np.flatnonzero(total)
            for lo in range(0, len(state), 1 << 16):
                cut = state[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cut), shard, np.int32)), pa.array(cut), pa.array(total[cut])],
                    names=["shard", "state", "n"],
                )

        return run

    return use


def counts(
    docs: DataFrame,
    support: int = MIN_COUNT,
    text_col: str = "text",
    lang_col: str = "lang",
    trie_phrases: int = TRIE,
    lexicon_words: int = LEXICON,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words of each language (lang, n), frequent words (code, lang, word, f), phrases (c1, c2, c3, f).

    Phrases of two words have c3 = -1. All counts are of all rows; a null text
    is empty, a null language `und`; a repeated row counts again; other columns
    are ignored; an empty table gives empty tables.
    """
    spark = docs.sparkSession
    batched(spark)
    rows = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("l"),
        F.col(f"`{text_col}`").cast("string").alias("t"),
    )
    words = written(
        rows.mapInArrow(_word_counts, "lang string, word string, n bigint")
        .groupBy("lang", "word").agg(F.sum("n").alias("f")),
        "word-counts",
    )
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= support)
    size = words.agg(F.sum("f").alias("n"), F.count_if(F.col("f") >= support).alias("v")).first()
    total, distinct = int(size.n or 0), int(size.v or 0)

    root = folder(spark, "lexicon")
    fs, base = pafs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    files = max(1, -(-distinct // lexicon_words))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            key = _keys(word_hashes(data, offs[:-1], offs[1:]), _lang_hash(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(key.view(np.int64)), pa.array(_range(key, files).astype(np.int32))],
                names=["lang", "word", "f", "key", "shard"],
            )

    placed = written(
        frequent.mapInArrow(keyed, "lang string, word string, f bigint, key bigint, shard int")
        .groupBy("shard")
        .applyInArrow(_lexicon_writer(root), "shard int, lang string, word string, f bigint, place bigint"),
        "lexicon",
    )
    in_file = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    bases = [0]
    for s in range(files):
        bases.append(bases[-1] + in_file.get(s, 0))
    at = F.get(F.array(*[F.lit(b).cast("bigint") for b in bases]), F.col("shard"))
    lexicon = placed.select((at + F.col("place")).alias("code"), "lang", "word", "f")
    digits = next(d for d in range(1, 5) if bases[-1] <= 1 << (8 * d))

    blocks = written(rows.mapInArrow(_blocks(Lexicon(root, tuple(bases))), "codes binary"), "word-codes")
    ranges = max(1, -(-total // RANGE))
    sieve = "range int, key binary, n binary"
    pairs = written(
        _sieved(blocks.mapInArrow(_pair_keys(ranges, support), sieve), support).select(
            F.col("high").alias("c1"), F.col("low").alias("c2"), F.lit(-1).cast("bigint").alias("c3")
        ),
        "pairs",
    )
    tries, shards = _tries(pairs, digits, trie_phrases)
    phrases = pairs
    # a trie's keys are a share of all
    some = max(1, -(-2 * ranges // shards))
    keys = _over_tries(blocks, tries, shards, total, _triple_keys(some, support, digits, shards), f"{sieve}, shard int")
    if keys is not None:
        own = tries.where(F.col("base").isNull()).select("shard", "state", "c1", "c2")
        found = _sieved(keys, support, "shard").select("shard", F.col("high").alias("state"), F.col("low").alias("c3"))
        phrases = phrases.unionByName(found.join(own, ["shard", "state"]).select("c1", "c2", "c3"))
    phrases = written(phrases, "phrases")
    if keys is not None:
        dropped(keys)
    both, shards = _tries(phrases, digits, trie_phrases)
    seen = _over_tries(blocks, both, shards, total, _state_counts(digits, shards), "shard int, state bigint, n bigint")
    if seen is None:
        return totals, lexicon, phrases.withColumn("f", F.lit(0).cast("bigint"))
    summed = seen.groupBy("shard", "state").agg(F.sum("n").alias("f"))
    named = both.where(F.col("base").isNull()).select("shard", "state", "c1", "c2", "c3")
    counted = written(named.join(summed, ["shard", "state"]).select("c1", "c2", "c3", "f"), "phrase-counts")
    dropped(blocks)
    return totals, lexicon, counted.where(F.col("f") >= support)


def score(a, left, right, scale: int = SCALE):
    """floor(scale * a^2 / (l * r)), exact for counts below 10^14 by 38-digit decimals."""
    wide = lambda c: f"cast({c} as decimal(14,0))"
    return F.expr(f"(cast({scale} as decimal(7,0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")


def mine(
    docs: DataFrame,
    support: int = MIN_COUNT,
    top: int = TOP,
    kept_share: int = KEPT_SHARE,
    text_col: str = "text",
    lang_col: str = "lang",
    trie_phrases: int = TRIE,
    lexicon_words: int = LEXICON,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language.

    The score of a phrase is that of its worst cut into two parts. A phrase
    inside a longer one that has `kept_share` percent of its count is left out.
    Ties go by count, then by the bytes of the phrase. Awkward rows: see `counts`.
    """
    totals, lexicon, counted = counts(docs, support, text_col, lang_col, trie_phrases, lexicon_words)
    pair = counted.where("c3 < 0").select("c1", "c2", F.col("f").alias("a"))
    triple = counted.where("c3 >= 0").withColumnRenamed("f", "a")

    def of(place: str, *keep: str) -> DataFrame:
        names = [F.col(k).alias(f"{k}{place}") for k in keep]
        return lexicon.select(F.col("code").alias(f"c{place}"), *names)

    longer = (
        triple.select("c1", "c2", "a")
        .unionAll(triple.select("c2", "c3", "a"))
        .groupBy("c1", "c2").agg(F.max("a").alias("longer"))
    )
    two = (
        pair.join(longer, ["c1", "c2"], "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < kept_share * F.col("a")))
        .join(of("1", "lang", "word", "f"), "c1").join(of("2", "word", "f"), "c2")
        .select(
            F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2").alias("phrase"), "a",
            F.col("f1").alias("l"), F.col("f2").alias("r"),
        )
        .withColumn("score", score("a", "l", "r"))
    )
    three = (
        triple.join(pair.withColumnRenamed("a", "f12"), ["c1", "c2"])
        .join(pair.select(F.col("c1").alias("c2"), F.col("c2").alias("c3"), F.col("a").alias("f23")), ["c2", "c3"])
        .join(of("1", "lang", "word", "f"), "c1").join(of("2", "word"), "c2").join(of("3", "word", "f"), "c3")
        .withColumn("s1", score("a", "f1", "f23")).withColumn("s2", score("a", "f12", "f3"))
    )
    late = F.col("s2") < F.col("s1")
    three = three.select(
        F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
        F.when(late, F.col("f12")).otherwise(F.col("f1")).alias("l"),
        F.when(late, F.col("f3")).otherwise(F.col("f23")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
