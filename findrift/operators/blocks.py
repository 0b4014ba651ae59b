"""Work on blocks of documents as Arrow and numpy arrays.

A posting is made of the words of one document, so nothing is hashed or sorted
beyond a batch of documents; as rows of single words the same work is a sort of
all words of a bucket.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Releases the files of a shuffle as soon as its query has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> None:
    """Let workers beside the driver find this package."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Values of all lists, and the length of each; a null list has none."""
    return lists.flatten(), np.diff(lists.offsets.to_numpy()) if not lists.null_count else lists.value_lengths().fill_null(0).to_numpy()


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole documents and the number of each row's document, from rows in the order of their id."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        rows = rows if held is None else pa.concat_tables([held, rows])
        ids = rows.column(0).to_pylist()
        last = len(ids) - 1
        while last and ids[last - 1] == ids[-1]:
            last -= 1
        held = rows.slice(last)
        if last:
            yield rows.slice(0, last), _numbered(ids[:last])
    if held is not None:
        yield held, np.zeros(held.num_rows, np.int64)


def _numbered(ids: list) -> np.ndarray:
    fresh = np.fromiter((a != b for a, b in zip(ids[1:], ids, strict=False)), bool, len(ids) - 1)
    return np.concatenate([[0], np.cumsum(fresh)])


def _postings_of(gap: int) -> Callable:
    """Postings of rows (id, field, exact, terms, owner) in the order of their id; rows of one id and field are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, doc in _whole_documents(batches):
            rows = rows.combine_chunks()
            one = lambda name: rows.column(name).combine_chunks()
            terms, size = _flat(one("terms"))
            if not len(terms):
                continue
            field = one("field").dictionary_encode()
            exact = one("exact").to_numpy(zero_copy_only=False)
            group = doc * len(field.dictionary) + field.indices.to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            first = np.cumsum(size) - size
            pos = (np.arange(len(row)) - first[row]).astype(np.int64)
            owner, owned = _flat(one("owner"))
            if len(owner):
                # owners are given for all terms of a row or for none
                pos[(owned > 0)[row]] += gap * owner.to_numpy()
            known = terms.dictionary_encode()
            code = known.indices.fill_null(len(known.dictionary)).to_numpy()
            key = group[row] * (len(known.dictionary) + 1) + code
            again = len(np.unique(group)) < len(group)
            order = np.lexsort((pos, key)) if again else np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            tf = np.diff(np.append(at, len(key)))
            length = np.where(exact, 1, size)
            lead = order[at]
            placed = ~exact[row[order]]
            ends = np.concatenate([[0], np.cumsum(np.where(exact[row[lead]], 0, tf))])
            out_row = pa.array(row[lead])
            arrays = [
                one("id").take(out_row),
                one("field").take(out_row),
                known.dictionary.take(pa.array(code[lead], mask=code[lead] == len(known.dictionary))),
                pa.array(tf.astype(np.int32)),
                pa.array(np.maximum.reduceat(length[row[order]], at).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pos[order][placed].astype(np.int32))),
            ]
            out = pa.RecordBatch.from_arrays(arrays, names=["id", "field", "term", "tf", "dl", "positions"])
            for lo in range(0, out.num_rows, 1 << 16):
                yield out.slice(lo, 1 << 16)

    return run


def _by_term(postings: Callable) -> Callable:
    """The postings of a partition in the order of field and term; the distinct terms are sorted, the rows by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, known = [], {}, []
        size = 0
        for batch in postings(batches):
            term, field = batch.column(2).dictionary_encode(), batch.column(1).dictionary_encode()
            own = np.array([names.setdefault(x, len(names)) for x in field.dictionary.to_pylist()])
            place = term.indices.fill_null(-1).to_numpy()
            held.append((batch, own[field.indices.to_numpy()], np.where(place >= 0, place + size, -1)))
            known.append(term.dictionary)
            size += len(term.dictionary)
        if not held:
            return
        every = pa.concat_arrays(known).dictionary_encode()
        rank = np.empty(len(every.dictionary), np.int64)
        rank[pc.sort_indices(every.dictionary).to_numpy()] = np.arange(len(rank))
        rank = np.append(rank[every.indices.to_numpy()], len(rank))  # the last is the null term
        field = np.concatenate([x[1] for x in held])
        order = np.argsort(field * len(rank) + rank[np.concatenate([x[2] for x in held])], kind="stable")
        rows = pa.Table.from_batches([x[0] for x in held]).combine_chunks()
        del held
        for lo in range(0, len(order), 1 << 16):
            yield from rows.take(pa.array(order[lo : lo + (1 << 16)])).combine_chunks().to_batches()

    return run


def postings_of(rows: DataFrame, gap: int, by_term: bool = False) -> DataFrame:
    """(id, field, term, tf, dl, positions) of `rows` (id, field, exact, terms, owner), which lie by id in the order of id.

    With `by_term` those of a partition come in the order of field and term.
    """
    ready(rows.sparkSession)
    use = _by_term(_postings_of(gap)) if by_term else _postings_of(gap)
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("field", T.StringType()),
        T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()),
        T.StructField("dl", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType())),
    ])
    return rows.mapInArrow(use, schema)
