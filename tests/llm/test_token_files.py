"""Flat token files against the tokenizers library and the rows themselves."""

import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd_rows import SF
from tokenizers import Tokenizer

from findrift.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def expected(rows, model, end=T.END):
    """(id, start, n, crc) by encoding every whole text alone."""
    made = []
    for i, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        made.append((i, zlib.crc32(ids.tobytes()), len(ids)))
    made.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for i, crc, n in made:
        out.append((i, at, n, crc))
        at += n
    return out


def found(spark, corpus):
    rows = T.read(spark, corpus).collect()
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1])


@pytest.mark.parametrize("part_bytes", [T.PART_BYTES, 20_000])
def test_odd_rows(spark, odd, model, part_bytes):
    corpus = T.write(odd, PATH, part_bytes=part_bytes)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(spark, corpus) == expected(rows, model)
    assert corpus.tokens == sum(p[3] for p in corpus.parts)


def test_all_documents(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(spark, T.write(docs.repartition(5), PATH, part_bytes=100_000)) == expected(rows, model)


def test_empty_table(spark, none):
    corpus = T.write(none, PATH)
    assert corpus.parts == () and corpus.tokens == 0
    assert T.read(spark, corpus).count() == 0


def test_repeated_id_fills_many_parts(spark):
    docs = spark.createDataFrame([(5, f"text {i % 3}") for i in range(400)], "doc_id bigint, text string")
    corpus = T.write(docs, PATH, part_bytes=300)
    assert len(corpus.parts) > 5
    rows = found(spark, corpus)
    assert [r[1] for r in rows] == list(np.cumsum([0] + [r[2] for r in rows])[:-1])


def test_text_ids_and_slices(spark, model):
    docs = spark.createDataFrame([("b", "two words"), ("a", "One, two;\tthree's  " * 50)], "doc_id string, text string")
    corpus = T.write(docs, PATH)
    flat = T.Flat(corpus.root, corpus.parts[0][0])
    assert flat.names.to_pylist() == ["a", "b"]
    whole = list(T.checksums(flat))
    assert whole == list(T.checksums(flat, 7))
    assert flat.ids(0, int(flat.offsets[1])).tolist() == [
        *model.encode("One, two;\tthree's  " * 50, add_special_tokens=False).ids, T.END
    ]
    fs_names = {f.base_name for f in flat.fs.get_file_info(T.pafs.FileSelector(flat.base)) if not f.base_name.startswith("_")}
    assert fs_names == {"part-000000.bin", "part-000000.idx", "part-000000.ids"}


def test_plain_letters_and_the_library_agree(model):
    """Every character that is cut and merged here, alone and between letters."""
    letters = [chr(c) for c in range(0x21, 0x530) if not chr(c).isspace()]
    words = [f for c in letters for f in (c, f"Ab{c}c", f"{c}'S", f"1{c}\u0301")]
    got = list(T.encoder(PATH)(words))
    want = model.encode_batch(words, add_special_tokens=False)
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == [e.ids for e in want]
    assert sum(T.PLAIN(w) is not None for w in words) > 5000


def test_words_stand_alone(model):
    texts = ["á é\ńx", "ΟΔΟΣ ΣΑΣ", "it's the end\x85now \x1c tail", "<|endoftext|> <|startoftext|>x", "  ", "İx I"]
    got = [np.frombuffer(b, "<u2").tolist() for b in T.encoder(PATH)(texts)]
    assert got == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_pretokens_are_merged_once(model, monkeypatch):
    """Words that differ by case, marks or text share the work of their pre-tokens."""
    seen, merged = [], T.WordEncoder._merged
    monkeypatch.setattr(T.WordEncoder, "_merged", lambda self, pieces: seen.extend(pieces) or merged(self, pieces))
    texts = ["The the THE the, (the) the's", None, "THE, Été été! the\nÉTÉ...", "the été"]
    encode = T.WordEncoder(PATH)
    got = [np.frombuffer(b, "<u2").tolist() for b in [*encode(texts), *encode(texts)]]
    assert got == [model.encode(t or "", add_special_tokens=False).ids for t in texts] * 2
    assert sorted(seen) == sorted({"the", ",", "(", ")", "'s", "été", "!", "..."})


def test_white_space_and_texts_without_words(model):
    texts = ["", " ", None, "\t\n\x0b\x0c\r ", "a\tb\nc\x0bd\x0ce\rf  g ", "Жук\tΣΑΣ \x00x", "", "\x1c\x85\xa0\u3000", None]
    want = [model.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u2").tolist() for b in T.encoder(PATH)(texts)] == want
    for t, ids in zip(texts, want, strict=True):
        assert [np.frombuffer(b, "<u2").tolist() for b in T.encoder(PATH)([t])] == [ids]
    assert list(T.encoder(PATH)([])) == []


@pytest.mark.parametrize("without", ["suffix", "lower case"])
def test_other_tokenizer_files(model, tmp_path, without):
    """Nothing in the ids tells where a pre-token ends; letters keep their case."""
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    if without == "suffix":
        file["model"]["end_of_word_suffix"] = None
    else:
        steps = file["normalizer"]["normalizers"]
        file["normalizer"]["normalizers"] = [x for x in steps if x["type"] != "Lowercase"]
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(file, f)
    texts = ["The words, the été's", "", "words 12 ..."]
    bare = Tokenizer.from_file(path)
    want = [bare.encode(t, add_special_tokens=False).ids for t in texts]
    assert want != [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u2").tolist() for b in T.WordEncoder(path)(texts)] == want


@pytest.mark.parametrize("size", [1, 5, 12, 1000])
def test_chunks_keep_all_rows(size):
    texts = ["abc", None, "", "defghijklmnopqrstu", "é", None, "xy", "z" * 9, ""]
    rows = pa.table({"i": range(len(texts)), "t": pa.array(texts, pa.string())})
    tables = list(T._chunks(iter(rows.to_batches(max_chunksize=4)), size))
    assert pa.concat_tables(tables).to_pylist() == rows.to_pylist()
    for t in tables:
        assert sum(len((x or "").encode()) for x in t.column("t").to_pylist()[:-1]) < size
    assert list(T._chunks(iter([]), size)) == []
