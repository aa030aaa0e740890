"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their leading stems (the first few bytes), so inflected
forms of one stem meet.  Every term that two texts of a bounded sample of labelled
ones hold is kept, whatever their labels.  Weights are counts times the log of the
inverse share, shrunk for terms of few examples, of which little is known;
vectors of unit length are the examples.

The examples are ordered by their leading common term, so that those of one
language stand together, and cut into blocks.  The index has, for each term, its
postings by block and the largest weight in each block.  A text sums these maxima
to a bound of its cosine with any example of a block, and visits blocks by falling
bound: the postings of its terms there are summed.  It stops when no bound left
reaches the k-th cosine found; the postings of all other blocks are skipped.
Postings of common terms are stored densely by block, so that the texts of a batch
that visit a block share one product; sums are in single precision, up to a proven
slack, and what can be a neighbour is scored in double.  The neighbours are the
exact ones.  Their votes, weighted by cosine, are
calibrated against leave-one-out votes of the examples themselves; the nearest
example and its cosine are the evidence.

Edge cases: a null or empty text, or one without any kept term, has no
neighbours and gets the calibrated rate of such examples; without labelled rows
every score is 0 and there is no evidence; repeated rows are scored alike;
equal cosines rank by example number; labels other than 0 and 1 are not learned
from; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .labelled import examples
from .op01_quality import _KIND
from .shared import held_out, small_batches, table, written


@dataclass(frozen=True)
class Toxicity:
    """Parameters of the method."""

    examples: int = 4096  # bound of the labelled sample
    least: int = 2  # examples that hold a kept term: one that a single example holds has no neighbour to tell
    shrink: float = 10.0  # weights are multiplied by n / (n + shrink), n the examples that hold the term
    stems: tuple[int, ...] = (4, 6)  # bytes, of longer words
    block: int = 64  # examples
    common: float = 1 / 32  # a term of more of the examples is common
    batch: int = 256  # texts scored together
    round: int = 8  # blocks visited between two looks at the bounds
    k: int = 15
    bins: int = 20  # of the calibration
    cut: float = 0.7
    seed: int = 9
    memo: int = 20_000  # answers that a worker keeps


def slack(terms: int) -> float:
    """Rounding of a sum of so many positive numbers, below 1 in all, in single precision."""
    return 2.0**-23 * (terms + 8)


def terms(texts: tk.Texts, p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every term occurrence."""
    low = texts.lowered()
    w = low._cut(_KIND[low.data] == 1)
    hashes, docs = [low.hashes(w)], [w.doc]
    for n in p.stems:
        longer = np.flatnonzero(w.ends - w.starts > n)
        s = tk.Spans(w.starts[longer], w.starts[longer] + n, w.doc[longer])
        hashes.append(tk.mix(low.hashes(s) + tk.U(n)))
        docs.append(s.doc)
    return np.concatenate(hashes), np.concatenate(docs)


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Index:
    """Examples as postings in blocks, with the votes' calibration."""

    def __init__(self, kept: np.ndarray, idf: np.ndarray, packed: list[bytes], lead: np.ndarray, label: np.ndarray, ids: np.ndarray, p: Toxicity):
        """``packed`` has the examples' terms and counts, ``lead`` the common term of largest weight or -1."""
        self.p, self.kept, self.idf = p, kept, idf
        some = np.flatnonzero(lead >= 0)
        order = some[np.lexsort((ids[some], lead[some]))]  # examples of one leading term stand together
        self.label, self.ids, self.packed = label[order], ids[order], [packed[i] for i in order]
        self.blocks = (len(order) + p.block - 1) // p.block
        blank = lead < 0
        self.base = (label[blank].sum() + label.mean()) / (blank.sum() + 1) if len(label) else 0.0
        self.rates = np.zeros(p.bins)
        self.shared = None  # its broadcast
        self.close()

    def close(self) -> None:
        self.memo: OrderedDict[bytes, tuple[float, int, float]] = OrderedDict()
        self.entries: np.ndarray | None = None
        self.visited = self.asked = 0  # blocks visited, and blocks in all, by the texts so far

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("p", "kept", "idf", "label", "ids", "packed", "blocks", "base", "rates")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.close()

    def open(self) -> None:
        """Postings by term and block with their maxima, made where they are used."""
        if self.entries is not None:
            return
        pairs = [unpacked(x) for x in self.packed]
        n = np.array([len(t) for t, _ in pairs], np.int64)
        self.bounds = np.append(0, np.cumsum(n))
        self.term = np.concatenate([t for t, _ in pairs]) if pairs else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(len(n)), n)
        self.weight = unit(self.term, np.concatenate([c for _, c in pairs]) if pairs else np.zeros(0), doc, len(n), self.idf)
        by = np.argsort(self.term, kind="stable")
        term, self.doc, self.val = self.term[by], doc[by].astype(np.int32), self.weight[by]
        new = np.ones(len(by), bool)
        new[1:] = (term[1:] != term[:-1]) | (self.doc[1:] // self.p.block != self.doc[:-1] // self.p.block)
        begin = np.flatnonzero(new)
        self.begin = np.append(begin, len(by))  # of the postings of an entry, a term in a block
        self.block, self.most = self.doc[begin] // self.p.block, np.maximum.reduceat(self.val, begin) if len(begin) else np.zeros(0)
        self.entries = np.searchsorted(term[begin], np.arange(len(self.kept) + 1))  # of a term
        often = np.flatnonzero(np.bincount(self.term, minlength=len(self.kept)) > max(self.p.common * len(n), 1))
        self.spread = np.zeros(len(self.kept))  # weights of one text by term, zero between uses
        self.column = np.full(len(self.kept), -1, np.int32)  # of the dense postings
        self.column[often] = np.arange(len(often))
        self.dense, self.tops = np.zeros((len(n), len(often)), np.float32), np.zeros((len(often), self.blocks), np.float32)
        for c, t in enumerate(often.tolist()):
            e = slice(self.entries[t], self.entries[t + 1])
            at = slice(self.begin[e.start], self.begin[e.stop])
            self.dense[self.doc[at], c], self.tops[c, self.block[e]] = self.val[at], self.most[e]

    def sums(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> np.ndarray:
        """Cosines of ``vectors`` and the examples of the blocks that they visit, in single precision; 0 for all others."""
        self.open()
        query, rare = np.zeros((len(vectors), self.dense.shape[1]), np.float32), []
        for i, (term, weight) in enumerate(vectors):
            column = self.column[term]
            query[i, column[column >= 0]] = weight[column >= 0]
            own = np.flatnonzero(column < 0)
            first, last = self.entries[term[own]], self.entries[term[own] + 1]
            entry = ranges(first, last)
            rare.append((entry, np.repeat(weight[own], last - first), self.block[entry]))
        room = np.array([2 * slack(len(term)) for term, _ in vectors])[:, None]
        bound = (query @ self.tops).astype(np.float64)
        for i, (entry, factor, block) in enumerate(rare):
            bound[i] += np.bincount(block, self.most[entry] * factor, minlength=self.blocks)
        some, bound = bound > 0, bound + room
        score, seen = np.zeros((len(vectors), len(self.label)), np.float32), np.zeros(bound.shape, bool)
        least = np.zeros((len(vectors), 1))
        k, first = min(self.p.k, len(self.label)), min(self.p.round, self.blocks)
        self.asked += bound.size
        while (due := some & ~seen & (bound >= least)).any():
            if not seen.any():  # the best blocks give the threshold
                due &= bound >= np.partition(bound, -first, axis=1)[:, [-first]]
            for b in np.flatnonzero(due.any(0)).tolist():
                who, rows = np.flatnonzero(due[:, b]), slice(b * self.p.block, (b + 1) * self.p.block)
                score[who, rows] = query[who] @ self.dense[rows].T
            for i in np.flatnonzero(due.any(1)).tolist():
                entry, factor, block = rare[i]
                mine = np.flatnonzero(due[i][block])
                a, z = self.begin[entry[mine]], self.begin[entry[mine] + 1]
                posting = ranges(a, z)
                if len(posting):
                    score[i] += np.bincount(self.doc[posting], self.val[posting] * np.repeat(factor[mine], z - a), minlength=score.shape[1])
                if without is not None:
                    score[i, without[i]] = 0
            seen |= due
            least = np.partition(score, -k, axis=1)[:, [-k]] - room
        self.visited += int(seen.sum())
        return score

    def calibrate(self, votes: np.ndarray) -> None:
        """Mean outcome by equal steps of the examples' votes, made monotone (pool adjacent violators)."""
        p = self.p
        edge = np.minimum((votes * p.bins).astype(int), p.bins - 1) if len(votes) else np.zeros(0, int)
        n = np.bincount(edge, minlength=p.bins) + 1.0
        rate = (np.bincount(edge, self.label, minlength=p.bins) + (np.arange(p.bins) + 0.5) / p.bins) / n
        groups: list[list[float]] = []
        for r, m in zip(rate, n, strict=True):
            groups.append([r, m, 1])
            while len(groups) > 1 and groups[-2][0] > groups[-1][0]:
                r2, m2, c2 = groups.pop()
                r1, m1, c1 = groups.pop()
                groups.append([(r1 * m1 + r2 * m2) / (m1 + m2), m1 + m2, c1 + c2])
        self.rates = np.repeat([g[0] for g in groups], [g[2] for g in groups])

    def vectors(self, texts: tk.Texts) -> list[tuple[np.ndarray, np.ndarray]]:
        """Kept terms (ascending) and unit TF-IDF weights of each document."""
        t, _, weight, bounds = vectorise(*terms(texts, self.p), texts.n, self.kept, self.idf)
        return [(t[a:b], weight[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def nearest(self, term: np.ndarray, weight: np.ndarray, about: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k nearest examples, as (-cosine, example), exactly; ``about`` are the sums."""
        if not len(term) or not self.blocks:
            return []
        about = self.sums([(term, weight)])[0] if about is None else about
        k = min(self.p.k, len(about))
        at = np.flatnonzero((about > 0) & (about >= np.partition(about, -k)[-k] - 2 * slack(len(term)) - 1e-8))
        if not len(at):
            return []
        self.spread[term] = weight
        i, j = self.bounds[at], self.bounds[at + 1]
        row = ranges(i, j)
        score = np.add.reduceat(self.weight[row] * self.spread[self.term[row]], np.cumsum(j - i) - (j - i)).round(9)
        self.spread[term] = 0
        hit = np.flatnonzero(score > 0)
        return sorted(zip((-score[hit]).tolist(), at[hit].tolist(), strict=True))[: self.p.k]

    def vote(self, term: np.ndarray, weight: np.ndarray, about: np.ndarray | None = None, alone: float = float("nan")) -> tuple[float, int, float]:
        """Cosine-weighted vote, nearest example and its cosine; (``alone``, -1, 0) without neighbours."""
        best = self.nearest(term, weight, about)
        if not best:
            return alone, -1, 0.0
        cosine, at = -np.array([c for c, _ in best]), [i for _, i in best]
        return float(cosine @ self.label[at] / cosine.sum()), at[0], float(cosine[0])

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, int | None, float]]:
        """Calibrated score, evidence (id of the nearest example) and its cosine of each vector."""
        out = []
        for i in range(0, len(vectors), self.p.batch):
            some = vectors[i : i + self.p.batch]
            keys = [hashlib.blake2b(t.tobytes() + w.tobytes(), digest_size=16).digest() for t, w in some]
            new = {k: v for k, v in zip(keys, some, strict=True) if k not in self.memo}
            sums = self.sums(list(new.values())) if new and self.blocks else [None] * len(new)
            found = {k: self.memo[k] for k in keys if k not in new}
            found |= {k: self.vote(*v, about=c) for (k, v), c in zip(new.items(), sums, strict=True)}
            self.memo.update(found)
            while len(self.memo) > self.p.memo:
                self.memo.popitem(last=False)
            for k in keys:
                vote, at, cosine = found[k]
                x = np.clip(vote * self.p.bins - 0.5, 0, self.p.bins - 1)
                out.append((float(np.interp(x, np.arange(self.p.bins), self.rates)), int(self.ids[at]), cosine) if at >= 0 else (float(self.base), None, 0.0))
        return out


def unit(t: np.ndarray, tf: np.ndarray, d: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights, each document's of length 1."""
    if not len(t):
        return np.zeros(0)
    weight = tf * idf[t]
    return weight / np.sqrt(np.bincount(d, weight * weight, minlength=n))[d]


def packed(t: np.ndarray, tf: np.ndarray) -> bytes:
    """An example's ascending terms and their counts, made small for the way over the driver."""
    return zlib.compress(np.concatenate([np.diff(t, prepend=0), tf]).astype(np.int32).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, tf = np.frombuffer(zlib.decompress(data), np.int32).reshape(2, -1)
    return np.cumsum(step, dtype=np.int32), tf


def vectorise(h: np.ndarray, doc: np.ndarray, n: int, kept: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, counts and weights of all documents one after the other, and where each document begins."""
    at = np.minimum(np.searchsorted(kept, h), max(len(kept) - 1, 0))
    ok = kept[at] == h if len(kept) else np.zeros(len(h), bool)
    key, tf = np.unique(doc[ok] * (len(kept) + 1) + at[ok], return_counts=True)
    d, t = key // (len(kept) + 1), key % (len(kept) + 1)
    return t, tf, unit(t, tf, d, n, idf), np.searchsorted(d, np.arange(n + 1))


def fit(known: DataFrame, p: Toxicity) -> Index:
    """Index from ``known(doc_id, text, label)``; the driver gets the bounded sample's terms and vectors."""
    known = written(known.select("doc_id", "text", "label"), "toxicity-examples")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in tk.pieces(batch.column(0)):
                h, _ = tk.distinct(*terms(texts, p))
                u, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    total = known.count()
    counts = known.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    chosen = counts.where(f"n >= {p.least}").toArrow()
    kept = chosen.column("term").to_numpy().view(tk.U)
    order = np.argsort(kept)
    kept = kept[order]
    holders = chosen.column("n").to_numpy()[order]
    idf = np.log((total + 1) / (holders + 0.5)) * holders / (holders + p.shrink)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in tk.pieces(batch.column(1)):
                t, tf, weight, bounds = vectorise(*terms(texts, p), texts.n, kept, idf)
                cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                common = weight * (holders[t] > p.common * total)
                lead = [int(t[a + np.argmax(common[a:b])]) if b > a else -1 for a, b in cuts]
                columns = [batch.column(0).slice(i, texts.n), batch.column(2).slice(i, texts.n), pa.array(lead, pa.int64()), pa.array([packed(t[a:b], tf[a:b]) for a, b in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "lead", "packed"])

    found = known.mapInArrow(vectors, "doc_id long, label int, lead long, packed binary").toPandas().sort_values(["doc_id", "label"], kind="stable")
    index = Index(kept, idf, found["packed"].map(bytes).tolist(), found["lead"].to_numpy(np.int64), found["label"].to_numpy(np.float64), found["doc_id"].to_numpy(np.int64), p)
    index.shared = known.sparkSession.sparkContext.broadcast(index)  # bounded by the sample
    index.calibrate(own_votes(known.sparkSession, index))
    return index


def own_votes(spark: SparkSession, index: Index) -> np.ndarray:
    """Leave-one-out votes of the examples."""
    if not len(index.ids):
        return np.zeros(0)
    model = index.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value
        index.open()
        for batch in batches:
            n = batch.column(0).to_numpy()
            votes = []
            for m in np.split(n, range(index.p.block, len(n), index.p.block)):
                own = [(index.term[a:b], index.weight[a:b]) for a, b in zip(index.bounds[m], index.bounds[m + 1], strict=True)]
                votes += [index.vote(*v, about=c, alone=float(index.base))[0] for v, c in zip(own, index.sums(own, m.tolist()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], names=["n", "vote"])

    parts = spark.sparkContext.defaultParallelism
    found = spark.range(0, len(index.ids), 1, parts).select(F.col("id").alias("n")).mapInArrow(run, "n long, vote double").toArrow()
    out = np.zeros(len(index.ids))
    out[found.column("n").to_numpy()] = found.column("vote").to_numpy()
    return out


def score(documents: DataFrame, index: Index, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score, evidence (doc_id of the nearest example) and cosine of every document."""
    model, rates = index.shared, index.rates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value
        index.rates = rates
        for batch in batches:
            rows = index.scores([v for _, texts in tk.pieces(batch.column(len(keep))) for v in index.vectors(texts)])
            s, e, c = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [pa.array(np.round(np.array(s, float), 6)), pa.array(e, pa.int64()), pa.array(np.round(np.array(c, float), 6))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, "score", "evidence", "cosine"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    return documents.select(*keep, "text").mapInArrow(run, f"{schema}, score double, evidence long, cosine double")


def op5_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Toxicity()
    small_batches(spark)
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 3, 1)
    index = fit(examples(documents, labels, "toxic", ~out, p.examples, p.seed), p)
    scored = score(documents, index)
    predicted = F.when(F.col("score") >= p.cut, 1).otherwise(0)
    return scored.select("doc_id", out.alias("held_out"), "score", predicted.alias("predicted"), "evidence", "cosine")
