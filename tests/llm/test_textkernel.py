import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from foliant.llm import textkernel as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_texts(n=300, seed=3):
    r = random.Random(seed)
    pool = ["a", "b", "word", "é", "漢", " ", "  ", "\n", "\t", "\x0b", "x\x1cy", "##", "Ü"]
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(n)] + [None, "", " "]


def test_words_lines_and_grams_agree_with_python(monkeypatch):
    monkeypatch.setattr(tk, "PIECE", 64)  # many pieces
    texts, seen = random_texts(), {}
    for at, t in tk.pieces(pa.array(texts)):
        w = t.words()
        h = t.hashes(w)
        lines = t.lines()
        g, d = tk.grams(h, w.doc, 3)
        for q in range(t.n):
            text = texts[at + q] or ""
            words = WORD.findall(text)
            mine = h[w.doc == q]
            assert len(mine) == len(words)
            for word, x in zip(words, mine.tolist(), strict=True):
                assert seen.setdefault(word, x) == x
            assert int((lines.doc == q).sum()) == sum(1 for x in text.split("\n") if x)
            assert len(set(g[d == q].tolist())) == len(set(zip(words, words[1:], words[2:], strict=False)))
    assert len(set(seen.values())) == len(seen)


def test_empty_columns():
    assert list(tk.pieces(pa.array([], pa.string()))) == []
    (_, t), = tk.pieces(pa.array([None, None], pa.string()))
    assert t.n == 2 and len(t.words().starts) == 0 and t.count(np.zeros(0, bool)).tolist() == [0, 0]


def test_distinct():
    h, d = tk.distinct(np.array([5, 1, 5, 5], np.uint64), np.array([0, 0, 0, 1]))
    assert Counter(zip(h.tolist(), d.tolist(), strict=True)) == Counter([(1, 0), (5, 0), (5, 1)])
