import hashlib

import pyarrow as pa
import pytest

from foliant.llm import op12_middle as op

from .data import documents, odd_rows

SMALL = op.Middle(run=3, slice_bytes=200)


def expected(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["a", "é", "𝄞𝄞", "line\nbreaks\r\n\x0b\x00 and   more", "é combining 👩‍👩‍👧 family", "has <M> in it", "<S", "P><S><", "<" * 9, "abc", "abcd" * 200, "<P", "M>", "漢字" * 50]
ROWS = [(1000 + i, TEXTS[i % len(TEXTS)]) for i in range(40 * len(TEXTS))]


@pytest.mark.parametrize("p", [op.Middle(), SMALL, op.Middle(run=1), op.Middle(run=4)])
def test_against_python(spark, p):
    rows = ROWS + [r[:2] for r in odd_rows()]
    cut = op.fill_in_middle(documents(spark, rows, extra=True), p)
    assert cut.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(map(repr, (tuple(r) for r in cut.collect())))
    assert got == sorted(repr((i, *expected(i, t))) for i, t in rows)
    assert {f for _, f, *_ in (expected(*r) for r in rows)} == {"plain", "psm", "spm"}


def test_digests_and_way_back(spark):
    rows = ROWS + [r[:2] for r in odd_rows()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = op.digest(op.fill_in_middle(documents(spark, rows))).collect()
    want = [(i, *(e := expected(i, t))[:4], sha(e[4]), sha(t or "")) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_slices_hold_every_row_once():
    text = pa.array(["x" * n for n in (10, 500, 0, 300, 1, 1)] + [None])
    assert list(op._slices(text, 200)) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 7)]
    assert list(op._slices(text.slice(0, 0), 200)) == []


def test_kept_columns(spark):
    df = documents(spark, [(1, "some text"), (1, "some text"), (2, None)], extra=True).selectExpr("*", "'x' AS form", "'y' AS output")
    out = op.fill_in_middle(df, keep=("doc_id", "lang", "form", "rid"))
    assert out.columns == ["doc_id", "lang", "rid", "n", "form", "prefix_chars", "middle_chars", "output"] and out.count() == 3
    assert op.fill_in_middle(df, keep=()).count() == 3


def test_empty(spark):
    assert op.digest(op.fill_in_middle(documents(spark, odd_rows()).where("false"))).count() == 0
