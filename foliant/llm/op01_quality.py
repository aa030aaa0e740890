"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL.

Features are word n-grams hashed into a fixed number of weights: words and runs
of symbols as they stand, pairs of them, triples of their shapes (case, digits,
symbols, repetition of one of the last two words), and triples seen earlier in
the same text.  A text's vector is the share of each feature.  Weights are
learned with follow-the-regularised-leader updates (per-coordinate rates, L1 and
L2) on a bounded sample of labelled texts, in a few shards whose weights are
averaged; a score is the sparse dot product through the logistic function.

Edge cases: null or empty text has no features, and its score is the bias's;
without labelled rows every score is 0.5; repeated rows are scored alike;
labels other than 0 and 1 are not learned from; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .labelled import examples
from .shared import held_out, small_batches, table


@dataclass(frozen=True)
class Quality:
    """Parameters of the method."""

    examples: int = 8192  # bound of the labelled sample
    weights: int = 1 << 18
    shards: int = 4
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.05
    scale: float = 10.0  # of the shares
    cut: float = 0.7
    seed: int = 5


_KIND = np.zeros(256, np.uint8)  # 0 space, 1 letters and digits (and all beyond ASCII), 2 symbols
_KIND[33:127] = 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_KIND[:32] = 2
_KIND[127] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 0


def tokens(texts: tk.Texts) -> tk.Spans:
    """Runs of letters and digits, and runs of symbols."""
    kind = _KIND[texts.data]
    words, symbols = texts._cut(kind == 1), texts._cut(kind == 2)
    starts = np.concatenate([words.starts, symbols.starts])
    order = np.argsort(starts, kind="stable")
    return tk.Spans(starts[order], np.concatenate([words.ends, symbols.ends])[order], np.concatenate([words.doc, symbols.doc])[order])


def features(texts: tk.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature index and document of every n-gram occurrence."""
    t = tokens(texts)
    h, doc, data = texts.hashes(t), t.doc, texts.data
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = data[t.starts], data[t.ends - 1]
    upper = lambda b: (b >= 65) & (b <= 90)
    long = t.ends - t.starts > 1
    shape = np.where(_KIND[first] == 2, np.where(long, 5, 4), np.where((first >= 48) & (first <= 57), 3, np.where(upper(first), np.where(upper(last) & long, 2, 1), 0)))
    same = np.zeros(len(h), bool)
    for back in (1, 2):
        if len(h) > back:
            same[back:] |= (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
    shape = (shape * 2 + (same & (_KIND[first] == 1))).astype(tk.U)
    pairs, pair_doc = tk.grams(h, doc, 2)
    shapes, shape_doc = tk.grams(tk.mix(shape + tk.U(99)), doc, 3)
    triples, triple_doc = tk.grams(h, doc, 3)
    order = np.lexsort((triples, triple_doc))
    again = np.zeros(len(order), bool)
    again[1:] = (triples[order][1:] == triples[order][:-1]) & (triple_doc[order][1:] == triple_doc[order][:-1])
    seen_doc = triple_doc[order][again]
    seen = np.full(len(seen_doc), tk.U(0x1234567))
    index = np.concatenate([h, pairs, shapes, seen]) % tk.U(size)
    return index.astype(np.int64), np.concatenate([doc, pair_doc, shape_doc, seen_doc])


def _train(rows: list[tuple[np.ndarray, np.ndarray, int]], p: Quality) -> np.ndarray:
    """FTRL-proximal over sparse rows (index, value, label); the last weight is the bias."""
    z, n = np.zeros(p.weights + 1), np.zeros(p.weights + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    order = np.random.RandomState(p.seed)
    for _ in range(p.epochs):
        for r in order.permutation(len(rows)):
            i, x, y = rows[r]
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha * w
            n[i] += g * g
    return weight(np.arange(p.weights + 1))


def _vectors(texts: tk.Texts, p: Quality) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse vector of each document, the bias last."""
    index, doc = features(texts, p.weights)
    total = np.bincount(doc, minlength=texts.n)
    key, count = np.unique(doc * p.weights + index, return_counts=True)
    bounds = np.searchsorted(key, np.arange(texts.n + 1) * p.weights)
    for q in range(texts.n):
        a, b = bounds[q], bounds[q + 1]
        yield np.append(key[a:b] - q * p.weights, p.weights), np.append(count[a:b] / max(total[q], 1) * p.scale, 1.0)


def fit(known: DataFrame, p: Quality) -> np.ndarray:
    """Weights from ``known(doc_id, text, label)``, averaged over shards; at most so many numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            label = batch.column(1).to_pylist()
            for i, texts in tk.pieces(batch.column(0)):
                rows += [(x, v, label[i + q]) for q, (x, v) in enumerate(_vectors(texts, p))]
        if rows:
            w = _train(rows, p)
            i = np.append(np.flatnonzero(w), p.weights + 1)  # one more, to count the shards
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(np.append(w[i[:-1]], 1.0))], names=["i", "w"])

    dealt = known.repartition(p.shards, F.pmod(F.xxhash64("doc_id"), F.lit(p.shards))).sortWithinPartitions("doc_id", "text", "label")
    sums = dealt.select("text", "label").mapInArrow(run, "i long, w double").groupBy("i").agg(F.sum("w").alias("w")).toPandas()
    w = np.zeros(p.weights + 2)
    w[sums["i"]] = sums["w"]
    return (w[:-1] / max(w[-1], 1.0)).astype(np.float32)


def score(documents: DataFrame, weights: np.ndarray, p: Quality, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score of every document."""
    model = documents.sparkSession.sparkContext.broadcast(weights)  # fixed number of weights
    kept = documents.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value.astype(np.float64)
        for batch in batches:
            scores = [np.zeros(0)]
            for _, texts in tk.pieces(batch.column(len(keep))):
                index, doc = features(texts, p.weights)
                total = np.maximum(np.bincount(doc, minlength=texts.n), 1)
                dot = np.bincount(doc, w[index], minlength=texts.n) / total * p.scale + w[p.weights]
                scores.append(1 / (1 + np.exp(-np.clip(dot, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(scores).round(6))], names=[*keep, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return documents.select(*keep, "text").mapInArrow(run, f"{schema}, score double")


def op1_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Quality()
    small_batches(spark)
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 4, 2)
    weights = fit(examples(documents, labels, "quality", ~out, p.examples, p.seed), p)
    scored = score(documents, weights, p)
    return scored.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= p.cut, 1).otherwise(0).alias("predicted"))
