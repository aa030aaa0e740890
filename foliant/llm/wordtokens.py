"""Public tokenizers applied unit by unit, each distinct unit encoded once per worker.

The vocabularies used here never merge across ASCII white space, so a text's
tokens are its words' tokens one after the other.  For the lower-casing word
vocabulary the units are finer: runs of letters, digits and runs of symbols,
where these are plain to see in the bytes, and whole words elsewhere.  A task
keeps the tokens of the units that it has seen, by 64-bit hash, up to a number
of bytes, then starts afresh; when the task ends, tokens and vocabulary go.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable
from itertools import chain

import numpy as np

from . import textkernel as tk

CACHE_BYTES = 24 << 20  # of the tokens of one vocabulary


def give_back() -> None:
    """Freed memory back to the system, where the C library can: workers live on under other operators' tasks."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def place(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file; ``folder`` is where they are if not where the installed package has them."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: From a byte buffer and spans of it to all ids one after the other, and the number of ids of each span.
Encode = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def listed(encode: Callable[[list[str]], list[list[int]]]) -> Encode:
    """``encode`` of a list of words, for spans."""

    def run(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        ids = encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(length.sum())), length

    return run


def encoder(name: str, folder: str | None = None, lead: str = "") -> Callable[[list[str]], list[list[int]]]:
    """A function from a list of words to their id lists; ``lead`` goes before each word."""
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=place(name, folder))
        return lambda words: sp.encode([lead + w for w in words] if lead else words, num_threads=1)
    if name.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(place(name, folder), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        ordinary = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda words: [ordinary(lead + w) for w in words]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(place(name, folder))
    return lambda words: [e.ids for e in t.encode_batch([lead + w for w in words], add_special_tokens=False)]


def byte_ids(name: str, folder: str | None = None) -> np.ndarray:
    """Which ids stand for single bytes that no piece covers; none in vocabularies without byte fallback."""
    if not name.endswith(".model"):
        return np.zeros(1 << 20, bool)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=place(name, folder))
    return np.array([sp.is_byte(i) for i in range(sp.vocab_size())])


#: Bytes of units that the word vocabulary takes as one piece each when they stand between spaces; not quotes and less-than signs.
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
_PLAIN[[ord("'"), ord("<")]] = False


def _plain_units(data: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` units hold plain ASCII, and letters of the first 256 code points in two bytes, alone."""
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7) & (unit[1:] == unit[:-1])
    follows = np.zeros(len(data), bool)
    follows[1:] = lead[:-1]
    return np.bincount(unit[~(_PLAIN[data] | lead | follows)], minlength=n) == 0


def unit_encoder(name: str, folder: str | None = None) -> Encode:
    """Encoder of ``word_units`` for a lower-casing vocabulary with word ends.

    Plain units are encoded together, with spaces between: every one of them
    ends with a token that carries the word end, and no other token does."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(place(name, folder))
    last = np.zeros(t.get_vocab_size() + 1, bool)
    last[[i for token, i in t.get_vocab().items() if token.endswith("</w>")]] = True

    def encode(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(starts), ends - starts
        unit = np.repeat(np.arange(n), size)
        some = data[np.arange(len(unit)) + np.repeat(starts - (np.cumsum(size) - size), size)]
        plain = _plain_units(some, unit, n)
        # Plain units with a space after each.
        mine = plain[unit]
        length = size[plain] + 1
        text = np.full(int(length.sum()), 32, np.uint8)
        text[np.arange(int(mine.sum())) + np.repeat(np.arange(len(length)), size[plain])] = some[mine]
        stop = np.cumsum(length)
        raw, found, count = text.tobytes(), [], np.zeros(n, np.int64)
        which = np.flatnonzero(plain)
        for a in range(0, len(which), 512):
            b = min(a + 512, len(which))
            ids = np.array(t.encode(raw[int(stop[a] - length[a]) : int(stop[b - 1])].decode(), add_special_tokens=False).ids, np.int32)
            at = np.flatnonzero(last[ids]) + 1
            if len(at) != b - a or at[-1] != len(ids):
                raise ValueError(f"{name} doesn't end each plain unit with one word end")
            count[which[a:b]] = np.diff(at, prepend=0)
            found.append(ids)
        rest = np.flatnonzero(~plain)
        words = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        other = [e.ids for e in t.encode_batch(words, add_special_tokens=False)]
        count[rest] = list(map(len, other))
        out, of = np.zeros(int(count.sum()), np.int32), np.repeat(plain, count)
        out[of] = np.concatenate(found) if found else 0
        out[~of] = list(chain.from_iterable(other))
        return out, count

    return encode


_CLASS = np.zeros(256, np.uint8)  # of plain bytes: 1 letter, 2 digit, 3 symbol; 0 anything else
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[[ord("'"), ord("<")]] = 0  # contractions and special tokens: left to the tokenizer


def word_units(texts: tk.Texts) -> tuple[tk.Texts, tk.Spans]:
    """Units of a lower-casing word vocabulary, and the texts with plain words lower-cased.

    A word is plain if it is ASCII without quotes and less-than signs, or letters
    of the first 256 code points in two bytes (stable under NFC)."""
    data = texts.data
    w = texts.words()
    n = len(data)
    second = np.zeros(n, bool)
    second[1:] = data[:-1] == 0xC3
    accented = second & (data >= 0x80) & (data != 0x97) & (data != 0xB7)
    before = np.zeros(n, bool)
    before[:-1] = accented[1:]
    kind = _CLASS[data]
    kind[accented] = 1
    kind[(data == 0xC3) & before] = 1
    odd = np.zeros(n + 1, np.int64)
    np.cumsum((kind == 0) & ~tk.SPACE[data], out=odd[1:])
    plain = odd[w.ends] == odd[w.starts]
    inside = np.zeros(n + 1, np.int8)  # +1 over plain words
    inside[w.starts[plain]] += 1
    inside[w.ends[plain]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    lowered = data.copy()
    lowered[inside & (data >= 65) & (data <= 90)] += 32
    lowered[inside & accented & (data <= 0x9E)] += 32
    begins = np.zeros(n, bool)
    begins[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    begins[w.starts] = True
    starts = np.flatnonzero(begins)
    # A unit ends where the next one of its word begins, or with the word.
    word = np.searchsorted(w.starts, starts, "right") - 1
    ends = w.ends[word] if len(starts) else starts
    same = np.zeros(len(starts), bool)
    same[:-1] = word[1:] == word[:-1]
    ends = np.where(same, np.append(starts[1:], 0), ends)
    return tk.Texts(lowered, texts.offsets), tk.Spans(starts, ends, w.doc[word] if len(starts) else starts)


class WordTokens:
    """Token ids of words or units, with a cache by hash of about ``most`` bytes; a context of one task.

    Known hashes stand in two sorted arrays, a large one and the recent ones."""

    def __init__(self, encode: Encode, most: int = CACHE_BYTES):
        self.encode, self.most = encode, most
        self._reset()

    def __enter__(self) -> WordTokens:
        return self

    def __exit__(self, *error) -> None:
        self.encode = None
        self._reset()
        give_back()

    @property
    def nbytes(self) -> int:
        return self.flat.nbytes + self.start.nbytes + self.length.nbytes + sum(h.nbytes + s.nbytes for h, s in self.known)

    def _reset(self) -> None:
        self.known = [(np.zeros(0, tk.U), np.zeros(0, np.int32))] * 2
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        for h, slot in self.known:
            if len(h):
                at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
                hit = h[at] == hashes
                out[hit] = slot[at[hit]]
        return out

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _add(self, hashes: np.ndarray, flat: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Slots of new words with their ids; ``hashes`` ascend."""
        self.flat = self._grown(self.flat, self.used + len(flat))
        self.start, self.length = self._grown(self.start, self.n + len(length)), self._grown(self.length, self.n + len(length))
        self.flat[self.used : self.used + len(flat)] = flat
        slots = np.arange(self.n, self.n + len(length))
        self.start[slots], self.length[slots] = self.used + np.cumsum(length) - length, length
        self.used, self.n = self.used + len(flat), self.n + len(length)
        merged = [self.known[1], (hashes, slots.astype(np.int32))]
        full = len(self.known[1][0]) > len(self.known[0][0]) // 8 + 4096
        if full:  # the recent ones join the large array
            merged.append(self.known[0])
        h, s = np.concatenate([a for a, _ in merged]), np.concatenate([b for _, b in merged])
        order = np.argsort(h, kind="stable")
        done = (h[order], s[order])
        self.known = [done, (np.zeros(0, tk.U), np.zeros(0, np.int32))] if full else [self.known[0], done]
        return slots

    def tokens(self, texts: tk.Texts, words: tk.Spans, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the number of ids of each word."""
        if self.nbytes > self.most:
            self._reset()
        u, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slots = self._find(u)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = self._add(u[new], *self.encode(texts.data, words.starts[first[new]], words.ends[first[new]]))
        slots = slots[inverse]
        length = self.length[slots].astype(np.int64)
        begin = np.cumsum(length) - length
        at = np.repeat(self.start[slots] - begin, length) + np.arange(int(length.sum()))
        return self.flat[at], length
