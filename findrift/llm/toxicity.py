"""Toxicity of documents and their sentences, learnt from document labels only.

Multiple-instance learning: a sentence has the logistic score of its features, a
document the noisy-or of its sentences, and the weights are fitted to document
labels through that noisy-or. A document is thus as toxic as its sentences make
it, and the sentences at fault are known without any sentence label.

Features are words and the first four and five letters of words. The classifier
is fitted on a bounded sample of the labelled rows: Spark counts which features
tell toxic documents in it, and the weights are fitted to it. Scoring is one
narrow pass over all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.llm.store import batched, dropped, written

THRESHOLD = 0.3
FEATURES = 4096  # kept, those that tell most
SAMPLE = 40_000  # labelled documents that the classifier is fitted on, at most
LEAST = 4  # toxic documents with a feature, at least
STEPS, RATE, PENALTY = 400, 0.1, 2e-5

_SENTENCE = re.compile(r"[^.!?\n]+")
_TRIM = " \t\r\x0b\x0c,;:()[]{}\"'`*#$%&|<>-_/\\~^+=@0123456789"


def word_features(word: str) -> tuple[str, ...]:
    """Features of a word: itself and its beginnings."""
    word = word.strip(_TRIM)
    if not word:
        return ()
    return (f"={word}", *(f"{word[:k]}" for k in (4, 5) if len(word) >= k))


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence with a word, in lower case."""
    for m in _SENTENCE.finditer(text):
        words = m.group().lower().split()
        if words:
            yield m.start(), m.end(), words


@dataclass(frozen=True)
class Model:
    """Weight of each feature, and the bias of a sentence."""

    weights: dict[str, float]
    bias: float


def features(rows: DataFrame, text_col: str = "text", label_col: str = "toxic", keep: int = FEATURES) -> list[str]:
    """The features that tell toxic documents best."""
    batched(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            cache: dict[str, tuple[str, ...]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                have = set()
                for word in set((text or "").lower().replace(".", " ").replace("!", " ").replace("?", " ").split()):
                    if word not in cache:
                        cache[word] = word_features(word)
                    have.update(cache[word])
                seen[label].update(have)
            names = list(seen[0].keys() | seen[1].keys())
            for lo in range(0, len(names), 50_000):
                part = names[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part, pa.string()),
                        pa.array([seen[1][x] for x in part], pa.int64()),
                        pa.array([seen[0][x] for x in part], pa.int64()),
                    ],
                    names=["feature", "toxic", "clean"],
                )

    counts = (
        rows.select(text_col, F.col(label_col).cast("int"))
        .mapInArrow(run, "feature string, toxic bigint, clean bigint")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= LEAST)
    )
    n = {r[0]: r[1] for r in rows.groupBy(F.col(label_col).cast("int")).count().collect()}
    ratio = F.log((F.col("toxic") + 0.5) / max(n.get(1, 0), 1) / ((F.col("clean") + 0.5) / max(n.get(0, 0), 1)))
    best = counts.where(ratio > 1).orderBy(F.desc(F.col("toxic") * ratio), "feature").limit(keep)
    return [r["feature"] for r in best.select("feature").collect()]


def _bags(names: list[str]):
    """Per document: its label, the features of each sentence that has any, and how many have none."""
    number = {f: k for k, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags, empty = [], []
            for text in batch.column(0).to_pylist():
                bag, none = [], 0
                for _, _, words in sentences(text or ""):
                    have = {number[f] for w in set(words) for f in word_features(w) if f in number}
                    if have:
                        bag.append(sorted(have))
                    else:
                        none += 1
                bags.append(bag)
                empty.append(none)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(bags, pa.list_(pa.list_(pa.int32()))), pa.array(empty, pa.int64())],
                names=["label", "bag", "empty"],
            )

    return run


def fit(bags: list[tuple[int, list[list[int]], int]], width: int) -> tuple[np.ndarray, float]:
    """Weights and bias that make the noisy-or of the sentences fit the labels (Adam, all rows at once)."""
    y = np.array([b[0] for b in bags], np.float64)
    empty = np.array([b[2] for b in bags], np.float64)
    doc = np.repeat(np.arange(len(bags)), [len(b[1]) for b in bags])
    flat = [s for b in bags for s in b[1]]
    sent = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    feat = np.array([f for s in flat for f in s], np.int64)
    w, bias = np.zeros(width + 1), -5.0
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(sent, w[feat], len(flat)) + w[-1] if len(flat) else np.zeros(0)
        soft = np.logaddexp(0, z)
        log_q = -(np.bincount(doc, soft, len(bags)) + empty * np.logaddexp(0, w[-1]))
        p = np.clip(-np.expm1(log_q), 1e-9, 1)
        pull = np.where(y == 1, -np.exp(log_q) / p, 1.0) / max(len(bags), 1)
        s = pull[doc] / (1 + np.exp(-z))
        g = np.zeros_like(w)
        g[:-1] = np.bincount(feat, s[sent], width) + 2 * PENALTY * w[:-1]
        g[-1] = s.sum() + (pull * empty).sum() / (1 + np.exp(-w[-1]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Model:
    """Learn from documents with a label of 0 or 1; other labels and null ids are ignored.

    Of two labels for one id the larger holds. At most `sample` ids, those of
    least hash, are used, so what is broadcast and what is fitted is bounded. No
    rows give a model that finds nothing.
    """
    spark = docs.sparkSession
    batched(spark)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    some = (
        known.groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("_id", F.lit(5)), "_id")
        .limit(sample)
    )
    some = written(some, "sampled-labels")
    text = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = written(text.join(F.broadcast(some), "_id").select("text", "label"), "sampled-texts")
    names = features(rows, "text", "label")
    bags = (
        rows.mapInArrow(_bags(names), "label int, bag array<array<int>>, empty bigint").collect()
    )
    dropped(rows)
    if not bags:
        return Model({}, -30.0)
    bags = sorted((r[0], r[1], r[2]) for r in bags)  # the same sums in any order of tasks
    w, bias = fit(bags, len(names))
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, bias)


class Scorer:
    """Scores of sentences and texts; the weight of a word is looked up once."""

    def __init__(self, model: Model, words: int = 300_000):
        self.model, self.words = model, words
        self.cache: dict[str, frozenset] = {}
        self.none = frozenset()

    def _hits(self, word: str) -> frozenset:
        if len(self.cache) >= self.words:
            self.cache = {}
        hits = frozenset(f for f in word_features(word) if f in self.model.weights) or self.none
        self.cache[word] = hits
        return hits

    def text(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The score of a text, and start, end and score of its sentences at or over the threshold."""
        weights, bias = self.model.weights, self.model.bias
        quiet = float(np.logaddexp(0, bias))
        log_q, found = 0.0, []
        for start, end, words in sentences(text):
            cache = self.cache
            hits = set()
            for w in words:
                h = cache.get(w)
                if h is None:
                    h = self._hits(w)
                if h:
                    hits |= h
            if not hits:
                log_q -= quiet
                continue
            z = bias + sum(weights[f] for f in sorted(hits))
            log_q -= float(np.logaddexp(0, z))
            p = 1 / (1 + np.exp(-z))
            if p >= THRESHOLD:
                found.append((start, end, float(p)))
        return max(0.0, -float(np.expm1(log_q))), found


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted, spans) of every row; spans are the sentences at fault.

    Null and empty texts have no sentence and score 0. Null and repeated ids are
    rows like others. Other columns are not read.
    """
    batched(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.text(t or "") for t in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in found], pa.float64()),
                    pa.array([int(x[0] >= THRESHOLD) for x in found], pa.int32()),
                    pa.array(spans, pa.list_(span)),
                ],
                names=[id_col, "score", "predicted", "spans"],
            )

    return docs.select(id_col, F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(
        run,
        f"`{id_col}` {kind}, score double, predicted int, "
        "spans array<struct<start: bigint, end: bigint, score: double>>",
    )


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they were."""
    batched(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            keep = [scorer.text(t or "")[0] < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
