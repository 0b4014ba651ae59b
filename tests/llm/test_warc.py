import gzip
import hashlib

import pyarrow.fs as pafs
import pytest

from findrift.llm import warc

BIG = "<p>" + "copy " * 400
PAGES = [
    (1, "http://a/1", BIG), (5, "http://a/5", BIG), (9, "http://b/9", BIG), (2, "http://a/2", "small"),
    (3, None, "small"), (4, "http://a/\n4", None), (None, "http://n", BIG), (6, "u", "é" * 600), (6, "u", "é" * 600),
    (9, "http://b/9", BIG), (7, "v", ""), (-3, "w", "x" * 300_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "k") for r in PAGES], "page_id bigint, url string, html string, shard int, kind string")


def expected():
    top = {}
    for i, _, h in PAGES:
        if len((h or "").encode()) >= 1000 and i is not None:
            top[h] = max(top.get(h, i), i)
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        t = top.get(h)
        revisit = t is not None and (i is None or i < t)
        out.append((i, "revisit" if revisit else "response", t if revisit else None, len(b), hashlib.sha1(b).hexdigest()))
    return sorted(out, key=str)


def files(archive):
    fs, base = pafs.FileSystem.from_uri(archive.root)
    out = {}
    for r in archive.manifest.collect():
        with fs.open_input_stream(f"{base}/{r['file']}", compression=None) as f:
            out[r["file"]] = f.read()
    return out


def test_round_trip(pages):
    archive = warc.write(pages)
    rows = warc.read(archive).collect()
    assert sorted(((r[0], r[2], r[3], r[4], r[5]) for r in rows), key=str) == expected()
    texts = {i: (h or "").encode() for i, _, h in PAGES}
    for r in rows:
        assert r["payload"] == (texts[r["page_id"]] if r["record_type"] == "response" else None)
    assert {r["page_id"]: r["url"] for r in rows}[3] is None


def test_same_bytes_however_the_rows_come(pages):
    a = warc.write(pages, shard_bytes=20_000, roll_bytes=2_000)
    b = warc.write(pages.repartition(7), shard_bytes=20_000, roll_bytes=2_000)
    fa = files(a)
    assert fa == files(b) and len(fa) > 2
    assert sum(r["records"] for r in a.manifest.collect()) == len(PAGES)
    assert sorted(((r[0], r[2], r[3], r[4], r[5]) for r in warc.read(b).collect()), key=str) == expected()
    first = gzip.decompress(next(iter(fa.values()))).split(b"\r\n")
    assert first[0] == warc.VERSION and first[1].startswith(b"WARC-Type: ")


def test_changed_files_are_noticed(pages):
    archive = warc.write(pages)
    fs, base = pafs.FileSystem.from_uri(archive.root)
    name = archive.manifest.first()["file"]
    with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\n\r\n\r\n\r\n"))
    with pytest.raises(Exception, match="does not match"):
        warc.read(archive).collect()


def test_empty(pages):
    archive = warc.write(pages.where("1 = 0"))
    assert archive.manifest.count() == 0 and warc.read(archive).count() == 0
