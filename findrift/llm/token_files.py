"""Token ids as flat binary files that readers map into memory.

A data set is a folder of parts. Part `p` has three files: `p.bin`, the ids of
its documents one after another as little-endian unsigned integers, two bytes
each where the vocabulary allows, else four; `p.idx`, a header and the 64-bit
offset, in ids, at which each document begins, with the end of the last; and
`p.ids`, the documents' own ids as an Arrow file. Documents ascend over all
parts. A part does not know what lies before it: bases come from prefix sums
over the manifest, one row per part, which Spark's own commit writes last.

Files are written under temporary names and renamed. Rows are cut into parts by
ranges of (id, hash of the text, row number), so a repeated id cannot fill a part, and a
repeated or doubled attempt writes the same bytes to the same name.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.llm.pieces import _Table
from findrift.llm.store import batched, folder, written

END = 2
PART_BYTES = 24 << 20  # text of a part, about
WORDS = 800_000  # distinct pre-tokens whose ids a worker keeps
CUT = 8 << 20  # bytes of text encoded at a time
MERGED = 50_000  # pre-tokens the library merges at a time
# printable, no white space, letters and digits that no version of Unicode has changed since
_PLAIN = "[!-~\u00A1-\u052F]+"
_LATIN = "[!-~\u00A1-\u02FF]+"
PLAIN = regex.compile(_PLAIN).fullmatch
_MARK = 0xFFFFFFFF  # no id: the end of a word
MARK = struct.pack("<I", _MARK)
SLICE = 1_000_000  # ids a reader holds at a time
MAGIC = b"TOKIDX01"
_HEAD = struct.Struct("<8sQQ")  # magic, bytes of an id, documents


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, so that words are encoded one by one.

    White space always ends a pre-token of such a tokenizer and no rule of its
    normalizer reaches across it; equal words therefore have equal ids wherever
    they stand, and each distinct one of some texts is encoded once. Words are cut
    out, numbered and replaced by their ids as arrays. Of a word in letters whose
    classes are settled (PLAIN), the file's normalizer, pattern and merges are
    applied to its distinct pre-tokens; other words go through the library whole.
    Tests compare both ways.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        cut, *rest = file["pre_tokenizer"]["pretokenizers"]
        plain = cut["type"] == "Split" and cut["behavior"] == "Removed" and cut["invert"]
        if not plain or rest != [{**rest[0], "type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]:
            raise ValueError("the tokenizer file does not cut words by one pattern")
        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.whole = getattr(model, "encode_batch_fast", model.encode_batch)
        self.width = 2 if model.get_vocab_size() <= 1 << 16 else 4
        # a blank marks the end of a word
        self.find = regex.compile(cut["pattern"]["Regex"] + "| ").findall
        self.normal = model.normalizer.normalize_str
        # letters up to U+02FF do not compose; where the file only makes them lower case, Python's does the same
        latin = [c for c in map(chr, range(0x300)) if regex.fullmatch(_LATIN, c)]
        sample = " ".join([*latin, "".join(latin)])
        self.lower = str.lower if self.normal(sample) == sample.lower() else self.normal
        merges = Tokenizer(model.model)
        merges.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.merges = getattr(merges, "encode_batch_fast", merges.encode_batch)
        # where each byte can end a pre-token, tokens with the suffix tell where it ends
        vocab, suffix = model.get_vocab(), file["model"].get("end_of_word_suffix")
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        if suffix and all(c + suffix in vocab for c in ByteLevel.alphabet()):
            self.closing[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.pieces = _Table(self._merged, WORDS)

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens by the file's merges."""
        out = []
        for k in range(0, len(pieces), MERGED):
            part = pieces[k : k + MERGED]
            ids = np.array(self.merges([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = [0, *(np.flatnonzero(self.closing[ids]) + 1).tolist()]
            if len(ends) != len(part) + 1:
                made = [e.ids for e in self.merges(part, add_special_tokens=False)]
                ids = np.array([i for x in made for i in x], "<u4")
                ends = list(accumulate(map(len, made), initial=0))
            held = ids.tobytes()
            out += [held[4 * i : 4 * j] for i, j in pairwise(ends)]
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some words, in any order; of each word its first place there and its number."""
        latin, plain = (pc.match_substring_regex(words, f"^{x}$").to_numpy(zero_copy_only=False) for x in (_LATIN, _PLAIN))
        first, second, third = (np.flatnonzero(x) for x in (latin, plain & ~latin, ~plain))
        text = self.lower(_joined(words, first))
        if len(second):
            text += " " * bool(text) + self.normal(_joined(words, second))
        cuts = self.find(text + " " if text else "")
        self.pieces.new[" "] = MARK
        self.pieces.learn(set(cuts))
        held = b"".join(map(self.pieces.new.__getitem__, cuts))
        self.pieces.turn()
        if len(third):
            made = self.whole(_joined(words, third).split(" "), add_special_tokens=False)
            held += b"".join([np.array(e.ids, "<u4").tobytes() + MARK for e in made])
        ids = np.frombuffer(held, "<u4")
        ends = np.flatnonzero(ids == _MARK)
        order = np.concatenate([first, second, third])
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[order] = np.concatenate([[0], ends + 1])[:-1]
        sizes[order] = ends - starts[order]
        return ids.astype(f"<u{self.width}"), starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; null is empty."""
        if not len(texts):
            return np.empty(0, f"<u{self.width}"), np.empty(0, np.int64)
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        ids, starts, sizes = self._words(words.dictionary)
        codes = words.indices.to_numpy()
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        places = np.repeat(starts[codes] - ends[:-1], n)
        places += np.arange(len(places))
        return ids[places], np.diff(ends[np.cumsum(pc.list_value_length(lists).to_numpy())], prepend=0)

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, as bytes; null is empty."""
        ids, sizes = self.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes)
        return (ids[i:j].tobytes() for i, j in zip(ends - sizes, ends, strict=True))


def _joined(words: pa.Array, places: np.ndarray) -> str:
    """Words at some places with a blank between them."""
    taken = words.take(pa.array(places))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken), " ")[0].as_py()


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of the batches, with about `size` bytes in their second column at a time."""
    held, left = [], size
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = before = 0
        while lo < len(batch):
            hi = min(int(np.searchsorted(ends, before + left)) + 1, len(batch))
            held.append(batch.slice(lo, hi - lo))
            left -= int(ends[hi - 1]) - before
            lo, before = hi, int(ends[hi - 1])
            if left <= 0:
                yield pa.Table.from_batches(held)
                held, left = [], size
    if held:
        yield pa.Table.from_batches(held)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _wide(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


@dataclass(frozen=True)
class Corpus:
    """A written data set: its folder, bytes of an id, type of the documents' ids, parts as (part, base, docs, ids)."""

    root: str
    width: int
    id_type: str
    parts: tuple[tuple[int, int, int, int], ...]

    @property
    def tokens(self) -> int:
        return self.parts[-1][1] + self.parts[-1][3] if self.parts else 0


def _name(part: int, kind: str) -> str:
    return f"part-{part:06d}.{kind}"


class _Part:
    """The files of one part while they are written."""

    def __init__(self, root: str, part: int, width: int):
        self.fs, self.base = pafs.FileSystem.from_uri(root)
        self.part, self.width, self.ends, self.names = part, width, [np.zeros(1, np.int64)], []
        self.tmp = f"{self.base}/_temporary-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.tmp}.bin")

    def add(self, names: pa.ChunkedArray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append documents in their order."""
        self.out.write(ids.tobytes())
        self.ends.append(self.ends[-1][-1] + np.cumsum(sizes))
        self.names += names.chunks

    def close(self) -> tuple[int, int, int]:
        self.out.close()
        ends = np.concatenate(self.ends)
        with self.fs.open_output_stream(f"{self.tmp}.idx") as f:
            f.write(_HEAD.pack(MAGIC, self.width, len(ends) - 1))
            f.write(ends.astype("<u8").tobytes())
        names = pa.table({"id": pa.chunked_array(self.names)})
        with self.fs.open_output_stream(f"{self.tmp}.ids") as f, pa.ipc.new_file(f, names.schema) as w:
            w.write_table(names)
        for kind in ("bin", "idx", "ids"):
            self.fs.move(f"{self.tmp}.{kind}", f"{self.base}/{_name(self.part, kind)}")
        return self.part, len(ends) - 1, int(ends[-1])


def _writer(root: str, path: str, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, out = encoder(path), None
        for rows in _chunks(batches, CUT):
            out = out or _Part(root, TaskContext.get().partitionId(), words.width)
            ids, sizes = words.encode(rows.column(1).combine_chunks())
            out.add(rows.column(0), np.insert(ids, np.cumsum(sizes), end), sizes + 1)
        if out:
            part, docs, ids = out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([docs]), pa.array([ids])], names=["part", "docs", "ids"]
            )

    return run


def write(
    docs: DataFrame,
    path: str,
    end: int = END,
    part_bytes: int = PART_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Corpus:
    """Encode all texts by the tokenizer file at `path` and write them in ascending order of id.

    A null or empty text is the one end id; a null id comes first; rows of one
    id come by a hash of the text, equal rows each keep their place; other
    columns are ignored. An empty table gives a data set without parts.
    """
    spark = docs.sparkSession
    batched(spark)
    root = folder(spark, "tokens")
    fs, base = pafs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_t"))
    total = int(rows.agg(F.sum(F.coalesce(F.octet_length("_t"), F.lit(0)) + 8)).first()[0] or 0)
    n = max(1, -(-total // part_bytes))
    key = ("_id", "_h", "_row")
    keyed = rows.withColumn("_h", F.xxhash64("_t")).withColumn("_row", F.monotonically_increasing_id())
    laid = keyed.repartitionByRange(n, *key).sortWithinPartitions(*key).select("_id", "_t")
    manifest = written(laid.mapInArrow(_writer(root, path, end), "part int, docs bigint, ids bigint"), "token-parts")
    parts, before = [], 0
    for r in manifest.orderBy("part").collect():  # a row per part
        parts.append((r.part, before, r.docs, r.ids))
        before += r.ids
    return Corpus(root, encoder(path).width, docs.schema[id_col].dataType.simpleString(), tuple(parts))


class Flat:
    """One part: offsets and names of its documents, and any range of ids without reading the rest."""

    def __init__(self, root: str, part: int):
        self.fs, self.base = pafs.FileSystem.from_uri(root)
        with self._open(_name(part, "idx")) as f:
            magic, self.width, self.docs = _HEAD.unpack(f.read(_HEAD.size))
            if magic != MAGIC:
                raise ValueError(f"part {part} is no token file")
            self.offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
        with self._open(_name(part, "ids")) as f:
            self.names = pa.ipc.open_file(f).read_all().column("id").combine_chunks()
        self.bin = self._open(_name(part, "bin"))

    def _open(self, name: str) -> pa.NativeFile:
        path = f"{self.base}/{name}"
        # a store without memory maps is read by ranges instead
        return pa.memory_map(path) if isinstance(self.fs, pafs.LocalFileSystem) else self.fs.open_input_file(path)

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.bin.read_at((stop - start) * self.width, start * self.width), f"<u{self.width}")


def checksums(flat: Flat, slice_ids: int = SLICE) -> Iterator[int]:
    """CRC-32 of each document's ids as unsigned 32-bit integers; at most `slice_ids` are held at a time."""
    at = 0
    ends = flat.offsets
    while at < flat.docs:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + slice_ids, "right")) - 1)
        if stop == at + 1 and ends[stop] - ends[at] > slice_ids:
            crc = 0
            for lo in range(ends[at], ends[stop], slice_ids):
                crc = zlib.crc32(_wide(flat.ids(lo, min(lo + slice_ids, ends[stop]))), crc)
            yield crc
        else:
            held = flat.ids(ends[at], ends[stop]).astype("<u4")
            for k in range(at, stop):
                yield zlib.crc32(held[ends[k] - ends[at] : ends[k + 1] - ends[at]])
        at = stop


def read(spark: SparkSession, corpus: Corpus, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32, part) of every document, from the files; one task per part."""
    batched(spark)
    names = [id_col, "start", "n_tokens", "ids_crc32", "part"]
    schema = f"`{id_col}` {corpus.id_type}, start bigint, n_tokens bigint, ids_crc32 bigint, part int"
    root, parts = corpus.root, corpus.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                part, base, docs, ids = parts[k]
                flat = Flat(root, part)
                if (flat.docs, int(flat.offsets[-1])) != (docs, ids):
                    raise ValueError(f"part {part} does not fit the manifest")
                crc = np.fromiter(checksums(flat), np.int64, docs)
                start, size = flat.offsets[:-1] + base, np.diff(flat.offsets)
                for lo in range(0, docs, 8192):
                    cut = slice(lo, lo + 8192)
                    yield pa.RecordBatch.from_arrays(
                        [
                            flat.names[cut], pa.array(start[cut]), pa.array(size[cut]), pa.array(crc[cut]),
                            pa.array(np.full(len(crc[cut]), part, np.int32)),
                        ],
                        names=names,
                    )

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(run, schema)
