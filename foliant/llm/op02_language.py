"""Language ID by multilingual mixture inference.

Each language is a distribution over hashed character n-grams of words, learned
from a bounded sample of texts per language.  A text is a mixture: every word
comes from one language, with the words' n-gram likelihoods given, and
expectation-maximisation estimates the languages' proportions.  The languages of
a text are the set that maximises the penalised likelihood: sets grow by the
strongest language of the full mixture, and one more must pay for its parameter;
growth ends where no larger set can win, since no likelihood exceeds that of each
word's best language.
The prediction is the language with the largest proportion in the chosen set,
and the score is that proportion.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, and so
is every text where no language was learned; repeated rows are judged alike; null
or empty lang teaches nothing; an empty table gives no rows; columns other than
doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as tk
from .op01_quality import _KIND
from .op05_toxicity import ranges
from .shared import crc_share, held_out, small_batches, table


@dataclass(frozen=True)
class Languages:
    """Parameters of the method."""

    per_language: int = 2048  # bound of the sample of each language
    buckets: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3, 4)  # bytes of an n-gram, with the word's ends
    smoothing: float = 0.2
    steps: int = 8  # of expectation-maximisation
    penalty: float = 3.0  # of one more language, times log of the number of words
    cells: int = 1 << 24  # n-grams or words times languages held at once
    seed: int = 3


_LIKELY = re.compile(r"[^\W\d_]")  # letters, and other numerals


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LIKELY.finditer(text))


def words_of(texts: tk.Texts) -> tuple[tk.Texts, tk.Spans]:
    """The lower-cased texts, and their words."""
    low = texts.lowered()
    return low, low._cut(_KIND[low.data] == 1)


def grams(texts: tk.Texts, p: Languages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and word of every n-gram inside words (lower-case, with word ends), and the document of each word."""
    low, w = words_of(texts)
    return *grams_of(low.data, w.starts, w.ends, p), w.doc


def grams_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: Languages) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word of every n-gram of the words between ``starts`` and ``ends``."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = ends - starts + 2
    begin = np.cumsum(length) - length
    word = np.repeat(np.arange(n), length)
    inner = np.arange(int(length.sum())) - begin[word]
    edge = (inner == 0) | (inner == length[word] - 1)
    code = np.zeros(len(word), np.uint64)
    code[~edge] = data[(starts[word] + inner - 1)[~edge]].astype(np.uint64)
    code[edge] = 1
    buckets, words = [], []
    h = np.zeros(len(word), np.uint64)
    for k in range(1, max(p.orders) + 1):
        m = len(word) - k + 1
        if m <= 0:
            break
        h = h[:m] * tk.U(257) + code[k - 1 :]
        if k in p.orders:
            ok = np.flatnonzero((word[:m] == word[k - 1 :]) & ~(edge[:m] if k == 1 else np.zeros(m, bool)))
            mixed = (h[ok] + tk.U(k << 40)) * tk.U(0x9E3779B97F4A7C15)
            buckets.append((mixed >> tk.U(40)).astype(np.int64) % p.buckets)
            words.append(word[ok])
    return np.concatenate(buckets), np.concatenate(words)


@dataclass
class Model:
    names: list[str]
    logs: np.ndarray  # buckets x languages, log probability


def sampled(rows: DataFrame, p: Languages) -> DataFrame:
    """lang and text of at most ``per_language`` rows of each language of ``rows(doc_id, text, lang)``, whatever the ids are.

    About twice the wanted share by hash, equal texts of one id folded where they
    are read, then the first so many of each language."""
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text", F.lit(p.seed)))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language, as the model has
    if not found:
        return rows.select("lang", "h", "text").where("false")
    rate = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * p.per_language / max(r["n"], 1))))])
    hashed = rows.where(crc_share(F.col("h"), p.seed) < F.try_element_at(rate, F.col("lang")))
    each = hashed.groupBy("lang", "h").agg(F.min("text").alias("text"))
    return each.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("_n") <= p.per_language).drop("_n")


def fit(documents: DataFrame, learn, p: Languages) -> Model:
    """Model from the rows of ``documents(doc_id, text, lang)`` where ``learn`` holds."""
    rows = documents.where(learn & F.col("lang").isNotNull() & (F.col("lang") != "")).select("doc_id", "text", "lang")
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not names:
        return Model([], np.zeros((p.buckets, 0), np.float32))
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    rows = sampled(rows, p).select("text", F.try_element_at(number, F.col("lang")).cast("long").alias("l"), F.pmod("h", F.lit(8)).alias("part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(1).to_numpy()
            for i, texts in tk.pieces(batch.column(0)):
                b, word, doc = grams(texts, p)
                l = lang[i + doc[word]] if len(word) else np.zeros(0, np.int64)
                key, n = np.unique(l * p.buckets + b, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // p.buckets), pa.array(key % p.buckets), pa.array(n)], names=["l", "b", "n"])

    counts = rows.repartition(8, "part").select("text", "l").mapInArrow(count, "l long, b long, n long")
    counts = counts.groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()  # at most languages x buckets
    total = np.zeros((len(names), p.buckets))
    total[counts["l"], counts["b"]] = counts["n"]
    every = total.sum(0) + 0.5
    prior = every / every.sum()
    size = np.maximum(total.sum(1, keepdims=True), 1)
    # Backing off to the mean of all languages: n-grams that a language never shows cost, unseen ones cost all alike.
    share = (total + p.smoothing * prior * p.buckets * 0.05 + 0.01) / (size + p.smoothing * p.buckets * 0.05 + 0.01 * p.buckets)
    return Model(names, np.log(share).T.astype(np.float32).copy())


def mixtures(texts: tk.Texts, model: Model, p: Languages) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document's chosen languages (documents x languages) and the set's size."""
    n, k = texts.n, len(model.names)
    out, size = np.zeros((n, k)), np.zeros(n, np.int64)
    low, w = words_of(texts)
    if not len(w.doc) or not k:
        return out, size
    # Each distinct word of the piece is read once; a document is its distinct words and how often each stands in it.
    _, first, which = np.unique(low.hashes(w), return_index=True, return_inverse=True)
    b, word = grams_of(low.data, w.starts[first], w.ends[first], p)
    order = np.argsort(word, kind="stable")
    b, cut = b[order], np.append(np.searchsorted(word[order], np.arange(len(first))), len(word))
    key, count = np.unique(w.doc * len(first) + which, return_counts=True)
    doc, which = key // len(first), key % len(first)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(starts[1:], len(doc))
    i = 0
    while i < len(starts):  # documents of so many words at once
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + max(p.cells // k, 1), "right")))
        rows = slice(starts[i], ends[j - 1])
        mine, at = np.unique(which[rows], return_inverse=True)
        like = likelihoods(b[ranges(cut[mine], cut[mine + 1])], np.append(0, np.cumsum(cut[mine + 1] - cut[mine])), model, p)
        out[doc[starts[i:j]]], size[doc[starts[i:j]]] = sets(like[at], ends[i:j] - starts[i:j], count[rows], p)
        i = j
    return out, size


def likelihoods(b: np.ndarray, first: np.ndarray, model: Model, p: Languages) -> np.ndarray:
    """Log likelihood of each word in each language; ``first`` cuts the buckets ``b`` into words."""
    like, i = np.zeros((len(first) - 1, len(model.names))), 0
    while i < len(like):
        j = max(i + 1, int(np.searchsorted(first, first[i] + max(p.cells // len(model.names), 1), "right")) - 1)
        like[i:j] = np.add.reduceat(model.logs[b[first[i] : first[j]]], first[i:j] - first[i], axis=0)
        i = j
    return like


def sets(like: np.ndarray, rows: np.ndarray, count: np.ndarray, p: Languages) -> tuple[np.ndarray, np.ndarray]:
    """Proportions in the set of highest penalised likelihood, and its size, of documents of so many ``rows`` each.

    A row is a distinct word of a document, ``count`` times in it."""
    n, k = len(rows), like.shape[1]
    ratio = np.exp(np.maximum(like - like.max(1, keepdims=True), -30.0))
    words = np.add.reduceat(count, np.cumsum(rows) - rows)

    def em(ratio: np.ndarray, rows: np.ndarray, count: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log likelihood with the columns' languages only."""
        starts, row = np.cumsum(rows) - rows, np.repeat(np.arange(len(rows)), rows)
        pi = np.full((len(rows), ratio.shape[1]), 1.0 / ratio.shape[1])
        if ratio.shape[1] > 1:
            for _ in range(p.steps):
                r = ratio * pi[row]
                r *= (count / np.maximum(r.sum(1), 1e-300))[:, None]
                pi = np.add.reduceat(r, starts, axis=0) / words[:, None]
        mix = np.maximum((ratio * pi[row]).sum(1), 1e-300)
        return pi, np.add.reduceat(np.log(mix) * count, starts)

    strongest = np.argsort(-em(ratio, rows, count, words)[0], axis=1, kind="stable")
    best, chosen, members = np.full(n, -np.inf), np.zeros((n, k)), np.zeros(n, np.int64)
    cost = p.penalty * np.log(words + 1.0)
    for m in range(1, k + 1):
        # Relative to each word's best language no log likelihood is above 0: what a set costs bounds its value.
        open_ = np.flatnonzero(best < -(m - 1) * cost)
        if not len(open_):
            break
        cols = np.sort(strongest[open_, :m], axis=1)
        some = np.repeat(best < -(m - 1) * cost, rows)
        pi, ll = em(np.take_along_axis(ratio[some], np.repeat(cols, rows[open_], axis=0), axis=1), rows[open_], count[some], words[open_])
        value = ll - (m - 1) * cost[open_]
        better = value > best[open_]
        at = open_[better]
        best[at], members[at], chosen[at] = value[better], m, 0
        chosen[at[:, None], cols[better]] = pi[better]
    return chosen, members


def identify(documents: DataFrame, model: Model, p: Languages, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score and languages (the chosen set by falling proportion) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # buckets x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            pred, score, sets = [], [], []
            for _, texts in tk.pieces(batch.column(len(keep))):
                share, size = mixtures(texts, model, p)
                for q in range(texts.n):
                    if not size[q] or not has_letter(texts.text(q)):
                        pred.append("und")
                        score.append(0.0)
                        sets.append([])
                        continue
                    order = np.argsort(-share[q], kind="stable")[: size[q]]
                    pred.append(model.names[order[0]])
                    score.append(round(float(share[q][order[0]]), 6))
                    sets.append([f"{model.names[j]}:{share[q][j]:.4f}" for j in order])
            columns = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, "lang_pred", "score", "languages"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    return documents.select(*keep, "text").mapInArrow(run, f"{schema}, lang_pred string, score double, languages array<string>")


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Languages()
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    found = identify(documents, fit(documents, ~out, p), p)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))
