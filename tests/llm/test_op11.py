import hashlib
import random
import re

import pytest

from foliant.llm import op11_decontaminate as op

from .data import documents, odd_rows

ASCII = str.maketrans(op.UPPER, op.UPPER.lower())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def expected(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(len(w), n)
        for s in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add("" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if (x := tuple(w[s : s + size])) in windows:
                    hit |= set(range(s, s + size))
                    found |= windows[x]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out)), out


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def got(found):
    return sorted(repr(tuple(r)) for r in op.digest(found).collect())


def cases(seed, count=60):
    """Texts over few words, so that windows meet by chance and overlap."""
    r = random.Random(seed)
    some = ["a", "b", "C", "é", "É", "x1", "漢", "𝄞"]
    line = lambda n: r.choice((" ", "")) + r.choice((" ", ", ", "\n", "--")).join(r.choice(some) for _ in range(n)) + r.choice(("", ".", " "))
    items = [(i, line(r.choice((1, 2, 3, 5, 7, 9, 10, 11, 14)))) for i in range(12) if i % 5]
    docs = [(i, line(r.randint(0, 40))) for i in range(count)]
    docs += [(100 + i, line(r.randint(0, 12)) + " " + r.choice(items)[1] + " " + line(r.randint(0, 12))) for i in range(count)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("p", [op.Overlap(), op.Overlap(words=4), op.Overlap(words=7, most_windows=9), op.Overlap(words=1)])
def test_against_python(spark, seed, p):
    docs, items = cases(seed)
    want, rows = expected(docs, items, p.words)
    assert got(op.find_overlaps(documents(spark, docs, extra=True), benchmark(spark, items), p)) == want
    assert any(r[2] for r in rows)


def test_odd_rows(spark):
    """Nulls and repeats on both sides, items that share an id, long texts."""
    odd = [r[:2] for r in odd_rows()]
    tail = " ".join(words(odd[9][1])[-25:])
    items = [(1, tail), (2, tail), (2, "漢字 かな"), (3, None), (4, ""), (5, " ., "), (None, "two words"), (None, tail[3:]), (7, odd[0][1])]
    want, rows = expected(odd, items)
    found = op.find_overlaps(documents(spark, odd, extra=True), benchmark(spark, items))
    assert got(found) == want and sum(r[2] > 0 for r in rows) >= 5
    assert len({tuple(r["items"]) for r in found.collect()}) > 3


def test_a_window_of_every_item_in_every_document(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"{i} {passage} {i}" if i % 3 else "w1 w2 w3") for i in range(300)]
    items = [(i, f"x{i} {passage}") for i in range(200)]
    want, _ = expected(docs, items)
    assert got(op.find_overlaps(documents(spark, docs), benchmark(spark, items))) == want


def test_removal(spark):
    passage = "One two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"Before it, {passage}. After."), (2, passage), (3, "Nothing here."), (3, "Nothing here."), (4, None), (None, f"{passage}!"), (5, f"{passage} and {passage} end"), (6, passage[4:])]
    df, items = documents(spark, docs, extra=True), benchmark(spark, [(1, passage), (2, "unseen")])
    out = op.remove_spans(df, items)
    assert out.columns == df.columns
    rows = sorted((str(r["doc_id"]), str(r["text"]), r["n_chars"]) for r in out.collect())
    assert rows == sorted([("1", "Before it, After.", 17), ("2", "", 0), ("3", "Nothing here.", 13), ("3", "Nothing here.", 13), ("4", "None", None), ("None", "", 0), ("5", "and end", 7), ("6", "", 0)])
    left = op.remove_documents(df, items)
    assert left.columns == df.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "3", "4"]


def test_empty_tables(spark):
    docs, items = documents(spark, odd_rows()), benchmark(spark, [(1, "some words")])
    assert op.digest(op.find_overlaps(docs.where("false"), items)).count() == 0
    free = op.digest(op.find_overlaps(docs, items.where("false"))).collect()
    assert len(free) == len(odd_rows()) and not any(r["contaminated"] for r in free) and {r["items_sha256"] for r in free} == {hashlib.sha256(b"").hexdigest()}
