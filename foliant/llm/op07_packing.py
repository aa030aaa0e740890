"""Packing along a space-filling curve.

Each document is a vector of hashed words, projected by random signs to a few
dimensions; its Hilbert key along these dimensions places similar documents
side by side.  The curve is cut into partitions of about equal bytes, by the
bytes of all documents in each cell of the curve; a cell with a large share of
a partition (copies, or one topic) is dealt over the partitions that it covers.
Each partition is sorted by key and cuts its stream of tokens into sequences.
What is left at a partition's end is cut at powers of two, so no sequence needs
padding.

The texts are written once with their keys and shuffled once; tokens are made
where the stream is cut and never stored.

Edge cases: null or empty text is the end token alone; repeated rows are packed
one by one; a null doc_id sorts first; an empty table gives no rows; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import crc_share, small_batches, table, written
from .wordtokens import WordTokens, unit_encoder, word_units


@dataclass(frozen=True)
class Packing:
    """Parameters of the method."""

    vocabulary: str = "word_bpe_49k.json"
    folder: str | None = None  # of the vocabulary, where not the installed one
    end_id: int = 2
    length: int = 4096  # of a sequence, a power of two
    dimensions: int = 6
    bits: int = 10  # per dimension
    cell_bits: int = 16  # of the key, for the bytes along the curve: the table of cells has at most two to this power rows
    partition_bytes: int = 32 << 20  # of texts in a partition, about


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``x`` (unsigned integers below 2**bits).

    Gray-code walk from the highest bit down: undo the rotations of the axes,
    then read the bits across dimensions."""
    x = x.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: tk.Texts, p: Packing) -> np.ndarray:
    """Hilbert key of each document."""
    low = texts.lowered()
    w = low.words()
    h = low.hashes(w)
    n = np.bincount(w.doc, minlength=texts.n)
    cells = np.zeros((texts.n, p.dimensions), np.int64)
    for j in range(p.dimensions):
        sign = ((h >> tk.U(j + 7)) & tk.U(1)).astype(np.float64) * 2 - 1
        score = np.bincount(w.doc, sign, minlength=texts.n) / np.sqrt(np.maximum(n, 1))
        share = 1 / (1 + np.exp(-np.clip(score, -8, 8)))
        cells[:, j] = np.minimum((share * (1 << p.bits)).astype(np.int64), (1 << p.bits) - 1)
    return hilbert(cells, p.bits)


def with_curve_key(documents: DataFrame, p: Packing) -> DataFrame:
    """doc_id, text and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [curve_keys(texts, p) for _, texts in tk.pieces(batch.column(1))]
            key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, pa.int64())], names=["doc_id", "text", "key"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, key long")


def dealt(documents: DataFrame, p: Packing) -> DataFrame:
    """doc_id and text in partitions of about equal bytes along the curve, each sorted by key."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    cell = F.shiftright("key", p.dimensions * p.bits - p.cell_bits)
    keyed = with_curve_key(documents, p).select("*", cell.alias("cell"), size.cast("long").alias("size"), F.monotonically_increasing_id().alias("rid"))
    keyed = written(keyed, "curve-keys")
    cells = written(keyed.groupBy("cell").agg(F.sum("size").alias("in_cell")), "curve-cells")
    total = cells.agg(F.sum("in_cell")).first()[0] or 0
    cores = keyed.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(total >> 20, max(cores, -(-total // p.partition_bytes))))
    before = F.coalesce(F.sum("in_cell").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.join(F.broadcast(cells.withColumn("before", before)), "cell")  # at most 2**cell_bits rows
    each = max(total / parts, 1.0)
    share = F.when(F.col("in_cell") > each / 4, crc_share(F.col("rid"), 7)).otherwise(F.lit(0.5))
    part = F.least(F.floor((F.col("before") + F.col("in_cell") * share) / each), F.lit(parts - 1)).cast("int")
    return placed.repartitionById(parts, part).sortWithinPartitions("key", "doc_id", "text").select("doc_id", "text")


class _Stream:
    """Pieces of the sequences of one partition; holds what the open sequence has so far."""

    def __init__(self, p: Packing, first_sequence: int):
        self.p, self.sequence = p, first_sequence
        self.doc: list = []
        self.begin = self.size = self.total = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def feed(self, doc: list, size: np.ndarray, ids: np.ndarray) -> list[tuple]:
        """Add documents with their ids; returns the pieces of the sequences that are full now."""
        self.doc += doc
        self.begin = np.concatenate([self.begin, np.zeros(len(size), np.int64)])
        self.size, self.total = np.concatenate([self.size, size]), np.concatenate([self.total, size])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        return self._emit(np.arange(0, len(self.ids) // self.p.length + 1) * self.p.length)

    def close(self) -> list[tuple]:
        """The rest, in sequences of powers of two."""
        left, bounds = len(self.ids), [0]
        for b in range(left.bit_length() - 1, -1, -1):
            if left >> b & 1:
                bounds.append(bounds[-1] + (1 << b))
        return self._emit(np.array(bounds))

    def _emit(self, bounds: np.ndarray) -> list[tuple]:
        """Cut at ``bounds``; what lies after the last one stays."""
        end = np.cumsum(self.size)
        start = end - self.size
        cut = np.union1d(np.concatenate([start, end]), bounds)
        at = np.searchsorted(end, cut[:-1], "right")  # the document of each piece
        sequence = np.searchsorted(bounds, cut[:-1], "right") - 1
        out, stop = [], int(bounds[-1])
        for a, b, i, s in zip(cut[:-1].tolist(), cut[1:].tolist(), at.tolist(), sequence.tolist(), strict=True):
            if b > stop:
                break
            crc = zlib.crc32(self.ids[a:b].astype("<u4").tobytes())
            out.append((self.doc[i], int(self.begin[i]) + a - int(start[i]), b - a, crc, int(self.total[i]), self.sequence + s, a - int(bounds[s])))
        self.sequence += len(bounds) - 1
        i = int(np.searchsorted(end, stop, "right"))  # the first document with ids after the cut
        self.doc, self.begin, self.size, self.total = self.doc[i:], self.begin[i:].copy(), self.size[i:].copy(), self.total[i:]
        if len(self.size):
            gone = stop - int(start[i])
            self.begin[0] += gone
            self.size[0] -= gone
        self.ids = self.ids[stop:]
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(documents: DataFrame, p: Packing = Packing()) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(p, TaskContext.get().partitionId() << 40)
        rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
        with WordTokens(unit_encoder(p.vocabulary, p.folder)) as cache:
            for batch in batches:
                ids_of = batch.column(0).to_pylist()
                for i, texts in tk.pieces(batch.column(1)):
                    lowered, units = word_units(texts)
                    ids, per_unit = cache.tokens(lowered, units, lowered.hashes(units))
                    doc = np.repeat(units.doc, per_unit)
                    size = np.bincount(doc, minlength=texts.n) + 1
                    every = np.full(int(size.sum()), p.end_id, np.uint32)
                    every[np.arange(len(ids)) + doc] = ids  # one end token for each document before
                    if out := stream.feed(ids_of[i : i + texts.n], size, every):
                        yield rows(out)
            if out := stream.close():
                yield rows(out)

    small_batches(documents.sparkSession)
    return dealt(documents, p).select("doc_id", "text").mapInArrow(run, PIECES)


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
