import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import op13_phrases as op
from foliant.llm import textkernel as tk

from .data import documents, odd_rows

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
        if w := [x for x in re.split(r"[\x20\x09]+", piece) if x]:
            yield w


def expected(rows, p):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, 5):
                for s in range(len(w) - k + 1):
                    f[lang, tuple(w[s : s + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= p.least}
    covered = Counter()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for s in range(len(w) - m + 1):
                covered[lang, w[s : s + m]] = max(covered[lang, w[s : s + m]], a)
    out = []
    for lang in n:
        mine = []
        for (of, w), a in found.items():
            if of == lang and not 100 * covered[lang, w] >= p.covered_percent * a:
                score, _, left, right = min((p.scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
                mine.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i, w.decode(), -a, left, right, n[lang], -score) for i, (score, a, w, left, right) in enumerate(sorted(mine)[: p.top], 1)]
    return sorted(out)


def texts(seed, count, words):
    r = random.Random(seed)
    some = ["the", "of", "A", "é", "É", "b\x01", "b", "漢字", "𝄞x", "#", "b!", "x-y", "no"][: r.randint(6, 13)]
    return [r.choice((" ", "", "\t")).join(("", r.choice((" ", "  ", " \t", ", ", ".\n")).join(r.choice(some) for _ in range(r.randint(0, words))))) for _ in range(count)]


def rows_of(seed, count=150, words=60):
    r = random.Random(seed)
    return [(i, t, r.choice(("en", "de", None, "und", "", "e")), "s") for i, t in enumerate(texts(seed, count, words))]


@pytest.mark.parametrize("p", [
    op.Phrases(), op.Phrases(least=5, top=40), op.Phrases(least=3, shard_tokens=200, range_bytes=1500), op.Phrases(least=2, shard_tokens=50, range_bytes=300, most_sent=0), op.Phrases(least=8, covered_percent=55, shard_tokens=1, range_bytes=4000, stride=3),
])
def test_against_python(spark, p):
    """Many shards, ranges that cut through prefixes, shuffled and broadcast joins: the counts are the same."""
    rows = rows_of(p.least, 1500 if p.least == 30 else 150)
    got = sorted(tuple(r) for r in op.collocations(documents(spark, rows, extra=True), p).collect())
    want = expected([(r[2], r[1]) for r in rows], p)
    assert got == want and len(want) > 20


def test_odd_rows(spark):
    p = op.Phrases(least=2, shard_tokens=20_000, range_bytes=40_000)
    rows = odd_rows() + [(50, "in in in in in in, IN in", None), (51, "in in in", "und")]
    got = sorted(tuple(r) for r in op.collocations(documents(spark, rows, extra=True), p).collect())
    want = expected([(r[2] if len(r) > 2 else "en", r[1]) for r in rows], p)
    assert got == want and any(r[0] == "und" and r[2] == "in in in in" for r in want)


def test_a_prefix_of_most_rows_is_in_many_ranges(spark):
    """A common pair of words with ever different words behind: its leaves are spread, and its counts are whole."""
    rows = [(i, f"all day w{i % 977} w{i % 31}. all day w{i} again", "en") for i in range(4000)]
    p = op.Phrases(range_bytes=8000)
    df = documents(spark, rows)
    cuts = op._cuts(df.selectExpr("text", "lang"), p)
    assert len(cuts) > 10 and sum(c[1].startswith(b"all day ") for c in cuts) > 5
    assert sorted(tuple(r) for r in op.collocations(df, p).collect()) == expected([(r[2], r[1]) for r in rows], p)


def test_blocks_and_merge():
    """Serialised blocks open to the same leaves, and runs merge to one trie, whatever the shards."""
    some = [t for t in texts(4, 80, 40)]
    lang = b"en"

    def leaves(part):
        words, piece, doc = op.words_of(tk.whole(pa.array(part)))
        return op.Leaves(words, piece, np.zeros(len(words), np.int64), [lang])

    whole = leaves(some)
    assert [whole.key(i) for i in range(len(whole.count))] == sorted({whole.key(i) for i in range(len(whole.count))})
    cut = [(lang, b"b "), (lang, whole.key(len(whole.count) // 2)[1]), (b"zz", b"")]
    blocks = [(r, op.opened(*leaf.block(a, b))) for leaf in map(leaves, (some[:30], some[30:31], some[31:])) for r, _, a, b in leaf.cut(cut)]
    total = []
    for r in range(4):
        mine = [b for x, b in blocks if x == r]
        if mine:
            keys, ranks, count = op.merged(mine)
            listed = [b"", *keys.to_pylist()]
            total += [(b"".join(listed[x] for x in column), int(c)) for column, c in zip(ranks.T, count, strict=True)]
    assert total == [(whole.key(i)[1], int(c)) for i, c in enumerate(whole.count)]


def test_counts_beyond_64_bits_of_products(spark):
    """2000000 * a passes 64 bits: the score is exact."""
    a = 9_000_000_000_000
    df = spark.createDataFrame([("en", 1, "x", a + 1, []), ("en", 1, "y", a, []), ("en", 2, "x y", a, [a + 1])], "lang string, depth int, phrase string, count long, lefts array<long>")
    row = op.linked(df).select("rights", op.best_cut(2_000_000).alias("best")).first()
    assert list(row["rights"]) == [a] and tuple(row["best"]) == (2_000_000 * a // (2 * a + 1), 1, a + 1, a)


def test_empty(spark):
    assert op.collocations(documents(spark, odd_rows()).where("false")).count() == 0
    assert op.collocations(documents(spark, [(1, None), (2, ""), (3, " .,\n")])).count() == 0
