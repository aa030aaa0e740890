"""Vectorised words, lines and hashes over Arrow string columns.

A batch's texts are one byte buffer with offsets; words, lines and n-grams are
found and hashed with numpy over the whole buffer, without a Python loop over
words.  Token hashes are polynomial prefix hashes modulo 2**64 over random byte
values, finished with a bit mixer, so equal tokens have equal hashes wherever
they stand.  Batches are cut at documents into pieces of about ``PIECE`` bytes;
one longer document is a piece of its own, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
U = np.uint64
_M = 0x9E3779B97F4A7C15 | 1
_M_INV = pow(_M, -1, 1 << 64)
_BYTE = np.random.RandomState(7).randint(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_POW = {"up": np.ones(1, U), "down": np.ones(1, U)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POW[kind]
    if len(have) < n:
        step = np.full(max(n, 2 * PIECE), U(_M if kind == "up" else _M_INV))
        step[0] = U(1)
        have = _POW[kind] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on uint64, a bijection."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@dataclass
class Spans:
    """Byte spans of tokens or lines, with the index of their document."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray


class Texts:
    """Some documents' texts as one byte buffer; ``offsets`` has one more entry than documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._prefix: np.ndarray | None = None

    def lowered(self) -> Texts:
        """With A-Z lower-cased, nothing else."""
        return Texts(LOWER[self.data], self.offsets)

    def _cut(self, inside: np.ndarray) -> Spans:
        """Maximal runs of ``inside`` that don't cross documents."""
        n = len(self.data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            filled = self.offsets[1:] > self.offsets[:-1]
            before[self.offsets[:-1][filled]] = False
            after[self.offsets[1:][filled] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return Spans(starts, ends, self.doc_of(starts))

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def words(self) -> Spans:
        """Runs of anything but ASCII white space."""
        return self._cut(~SPACE[self.data])

    def lines(self) -> Spans:
        """Non-empty pieces between line feeds."""
        return self._cut(self.data != 10)

    def hashes(self, s: Spans) -> np.ndarray:
        """64-bit hash of each span's bytes."""
        n = len(self.data)
        if self._prefix is None:
            self._prefix = np.zeros(n + 1, U)
            np.cumsum(_BYTE[self.data] * _powers("up", n), out=self._prefix[1:])
        raw = (self._prefix[s.ends] - self._prefix[s.starts]) * _powers("down", n + 1)[s.starts]
        return mix(raw + (s.ends - s.starts).astype(U))

    def count(self, mask: np.ndarray) -> np.ndarray:
        """True bytes of ``mask`` in each document."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def whole(column: pa.Array) -> Texts:
    """All texts of an Arrow column; nulls are empty."""
    a = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if a.null_count:
        a = a.fill_null("")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = a.buffers()[2] if len(a) else None
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return Texts(data, off - off[0])


def pieces(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """Consecutive documents of a column in pieces of about PIECE bytes, with the first one's index."""
    t, i = whole(column), 0
    while i < t.n:
        j = max(i + 1, int(np.searchsorted(t.offsets, t.offsets[i] + PIECE, "right")) - 1)
        yield i, Texts(t.data[t.offsets[i] : t.offsets[j]], t.offsets[i : j + 1] - t.offsets[i])
        i = j


def per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    """Start of each document's entries in an ascending array of document indexes, and its end."""
    return np.searchsorted(doc, np.arange(n + 1), "left")


def grams(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of k words of one document."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(m, U)
    for i in range(k):
        h = h * U(0x9FB21C651E98DF25) + hashes[i : i + m]
    same = doc[:m] == doc[k - 1 :]
    return mix(h[same]), doc[:m][same]


def distinct(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, by document and hash."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[first], d[first]
