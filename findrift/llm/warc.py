"""Deterministic sharded WARC writer and reader.

Records are cut into shards by ranges of page id and sorted inside a shard by
id and digest, so the bytes of every file follow from the rows alone. Files roll
by compressed size; every record is a gzip member. Headers, lengths and digests
are made anew from the payload. A file is written under a temporary name and
renamed when complete; a repeated or doubled attempt writes the same bytes to
the same name. The manifest, one row per file, is written last by Spark's own
commit and is what a reader trusts.

Payloads cross the network once: what a record must know about its copies comes
as a small mark that sorts just before it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.llm.store import batched, dropped, folder, written

REVISIT_BYTES = 1000  # smaller payloads are always written in full
SHARD_BYTES = 16 << 20  # payload of a shard, about
ROLL_BYTES = 8 << 20  # compressed size at which a file is closed
SAMPLE = 50_000  # page ids looked at, at most about, to place the ranges
DATE = "2024-01-01T00:00:00Z"  # of all records, so that a second run writes the same bytes
VERSION = b"WARC/1.1"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")


@dataclass(frozen=True)
class Archive:
    """A written archive: its folder and its manifest (file, shard, records, bytes, sha256)."""

    root: str
    manifest: DataFrame


def record_id(page_id: int | None, sha1: str, turn: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{sha1}/{turn}')}>"


def _sha1_text(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _clean(url: str | None) -> str:
    """A header value holds no line break."""
    return re.sub(r"[\r\n]+", " ", url or "")


def record(page_id, url, payload: bytes, turn: int, refers_to: int | None, has_target: bool) -> bytes:
    """The bytes of one record before compression; `turn` numbers equal rows."""
    sha1 = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if has_target:
        block = http + b"\r\n"
        kind = "revisit"
    else:
        block = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
        kind = "response"
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, sha1, turn)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", _sha1_text(sha1)),
        ("WARC-Block-Digest", _sha1_text(hashlib.sha1(block).hexdigest())),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if url is None:
        head.append(("X-No-Target", "1"))
    if has_target:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, sha1, 0)),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Files:
    """The open file of a shard."""

    def __init__(self, root: str, roll: int):
        self.fs, self.base = pafs.FileSystem.from_uri(root)
        self.roll, self.shard, self.out = roll, None, None

    def add(self, shard: int, data: bytes) -> Iterator[tuple]:
        if shard != self.shard:
            yield from self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self.name = f"shard-{shard:06d}-{self.number:05d}.warc.gz"
            self.tmp = f"{self.base}/_temporary-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.tmp, compression=None)
            self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)
        self.records += 1
        if self.bytes >= self.roll:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.tmp, f"{self.base}/{self.name}")
            yield (self.name, self.shard, self.records, self.bytes, self.sha.hexdigest())
            self.out, self.number = None, self.number + 1


MANIFEST = "file string, shard int, records bigint, bytes bigint, sha256 string"


def _writer(root: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, mark, last, turn, rows = _Files(root, roll), None, None, 0, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard, page, sha, kind, refers, url, payload = r
                if kind == 0:
                    mark = (page, sha, refers)
                    continue
                turn = turn + 1 if last == (page, sha) else 0
                last = (page, sha)
                copied = mark is not None and mark[:2] == last
                data = record(page, url, payload, turn, mark[2] if copied else None, copied)
                rows += files.add(shard, _gzip(data))
        rows += files.close()
        if rows:
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            cols = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "shard", "records", "bytes", "sha256"])

    return run


def _bounds(slim: DataFrame, shard_bytes: int) -> np.ndarray:
    """Last page ids of all shards but the last, from a sample that depends on the ids alone."""
    n, total = slim.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    every = max(1, -(-n // SAMPLE))
    rows = (
        slim.where("page_id is not null")
        .where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0)
        .groupBy("page_id")
        .agg(F.sum("n").alias("n"))
        .orderBy("page_id")
        .collect()
    )
    shards = max(1, -(-int(total) // shard_bytes))
    ids = np.array([r["page_id"] for r in rows], np.int64)
    if shards == 1 or len(ids) < 2:
        return ids[:0]
    upto = np.cumsum([r["n"] for r in rows])
    cut = np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards)
    return np.unique(ids[np.minimum(cut, len(ids) - 1)])


def _keys(spark: SparkSession, shards: int) -> list[int]:
    """One number per shard, each of which hash partitioning sends to a partition of its own."""
    rows = (
        spark.range(0, 20 * shards + 100)
        .groupBy(F.expr(f"pmod(hash(id), {shards})").alias("p"))
        .agg(F.min("id").alias("id"))
        .collect()
    )
    found = {r["p"]: r["id"] for r in rows}
    return [found.get(p, p) for p in range(shards)]


def write(
    pages: DataFrame,
    root: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> Archive:
    """Write a record per row; equal payloads of REVISIT_BYTES or more are stored once.

    Of equal large payloads the row with the largest id is the response, the
    others are revisits of it. Repeated rows with that largest id are responses
    all. A null payload is empty; a null id sorts first, is never a target, and
    revisits like others; a null address stays null. An empty table gives an
    archive without files. `root` is a folder that all executors reach.
    """
    spark = pages.sparkSession
    batched(spark)
    root = root or folder(spark, "warc")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    base = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"),
    )
    slim = written(
        base.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("bigint").alias("n")),
        "warc-slim",
    )
    bounds = _bounds(slim, shard_bytes)
    keys = np.array(_keys(spark, len(bounds) + 1), np.int64)

    @F.pandas_udf("int")
    def shard(page_id: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, page_id.fillna(np.iinfo(np.int64).min).astype(np.int64).to_numpy())
        return pd.Series(at.astype(np.int32))

    large = slim.where(F.col("n") >= REVISIT_BYTES)
    copies = large.groupBy("sha", "n").agg(F.max("page_id").alias("top"), F.count("*").alias("c")).where("c > 1")
    marks = written(
        large.join(copies.drop("c"), ["sha", "n"])
        .where("top is not null and (page_id is null or page_id < top)")
        .select("page_id", "sha", F.lit(0).alias("kind"), F.col("top").alias("refers"))
        .distinct(),
        "warc-marks",
    )
    rows = marks.select("*", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    rows = rows.unionAll(
        base.select(
            "page_id", F.sha1("payload").alias("sha"), F.lit(1), F.lit(None).cast("bigint"), "url", "payload"
        )
    ).withColumn("shard", shard(F.coalesce("page_id", F.lit(-(1 << 63)))))
    key = F.get(F.array(*[F.lit(int(k)).cast("bigint") for k in keys]), F.col("shard"))
    placed = (
        rows.repartition(len(keys), key)
        .sortWithinPartitions("shard", "page_id", "sha", "kind")
        .select("shard", "page_id", "sha", "kind", "refers", "url", "payload")
        .mapInArrow(_writer(root, roll_bytes), MANIFEST)
    )
    placed.write.mode("overwrite").parquet(f"{root}/_manifest")
    dropped(slim)
    dropped(marks)
    return Archive(root, spark.read.schema(MANIFEST).parquet(f"{root}/_manifest"))


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if line.rstrip(b"\r\n") != VERSION:
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).rstrip(b"\r\n"):
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("record is cut short")
        yield head, block


class _Members:
    """Lines and bytes of a file of gzip members, a part at a time."""

    def __init__(self, raw, part: int = 1 << 20):
        self.raw, self.part, self.buf, self.z = raw, part, b"", zlib.decompressobj(31)
        self.rest = b""

    def _more(self) -> bool:
        while True:
            data = self.rest or self.raw.read(self.part)
            self.rest = b""
            if not data:
                return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(data)
            self.rest = self.z.unused_data
            if out:
                self.buf += out
                return True

    def readline(self) -> bytes:
        while (at := self.buf.find(b"\n")) < 0:
            if not self._more():
                out, self.buf = self.buf, b""
                return out
        out, self.buf = self.buf[: at + 1], self.buf[at + 1 :]
        return out

    def read(self, n: int) -> bytes:
        parts, have = [self.buf], len(self.buf)
        while have < n:
            self.buf = b""
            if not self._more():
                break
            parts.append(self.buf)
            have += len(self.buf)
        data = b"".join(parts)
        self.buf = data[n:]
        return data[:n]


READ = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload binary"
)


def _reader(root: str, payloads: bool):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def rows_of(fs, path: str, sha256: str) -> Iterator[tuple]:
        with fs.open_input_stream(path, compression=None) as raw:
            sha = hashlib.sha256()

            class Hashed:
                def read(self, n: int) -> bytes:
                    data = raw.read(n)
                    sha.update(data)
                    return data

            for head, block in _records(_Members(Hashed())):
                payload = block.partition(b"\r\n\r\n")[2]
                digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                full = head["warc-type"] == "response"
                if full and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{path}: payload does not match its digest")
                number = lambda k: int(head[k]) if k in head else None
                yield (
                    number("x-page-id"), None if "x-no-target" in head else head["warc-target-uri"], head["warc-type"],
                    number("x-refers-to-page-id"), number("x-payload-length"), digest,
                    payload if full and payloads else None,
                )
            if sha.hexdigest() != sha256:
                raise ValueError(f"{path}: file does not match the manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            held, size = [], 0
            for name, sha256 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in rows_of(fs, f"{base}/{name}", sha256):
                    held.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > 8 << 20:
                        yield batch_of(held)
                        held, size = [], 0
            if held:
                yield batch_of(held)

    return run


def read(archive: Archive, payloads: bool = True) -> DataFrame:
    """One row per record: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload).

    Digest and length are those of the full payload, for revisits too, whose
    `payload` is null. Files are streamed, and checked against the manifest.
    """
    spark = archive.manifest.sparkSession
    batched(spark)
    n = max(1, archive.manifest.count())
    files = archive.manifest.select("file", "sha256").repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "file")
    return files.mapInArrow(_reader(archive.root, payloads), READ)
