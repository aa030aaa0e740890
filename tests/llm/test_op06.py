import random
import re

import numpy as np

from foliant.llm import op06_minhash as op
from foliant.llm.components import components

from .data import documents, odd_rows, prose


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, percent=85, k=3):
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join("x%d" % r.randrange(99) if r.random() < share else w for w in text.split())


def near_rows():
    rows = [(i, prose(i, 60 + i)) for i in range(40)]
    for g in range(4):
        rows += [(100 + 50 * g + i, edited(prose(900 + g, 150), 0.004 * (i % 9), i)) for i in range(30)]
    return rows + [(400, "A b"), (401, "a B"), (402, "a"), (403, "A"), (404, None), (405, ""), (406, " \n"), (1, "other text with the same id as another document has")]


def test_against_brute_force(spark, monkeypatch):
    rows = near_rows()
    docs = documents(spark, rows, extra=True)
    for block in (256, 8):
        monkeypatch.setattr(op, "block_pairs", lambda m, b=block: __import__("foliant.llm.blocks", fromlist=["x"]).block_pairs(m, b))
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op.near_duplicates(docs).collect())
        assert got == brute(rows)


def test_five_words_at_eighty_percent(spark):
    rows = near_rows()
    p = op.MinHash(shingle_words=5, percent=80, bands=32)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op.near_duplicates(documents(spark, rows), p).collect())
    assert got == brute(rows, 80, 5)


def test_one_of_each_group_stays(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    docs = documents(spark, rows, extra=True)
    out = op.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4, 5, 6, 7, 8, 9, 10, 11]


def test_null_ids_and_empty_table(spark):
    got = op.near_duplicates(documents(spark, [(None, "a b c d"), (None, None), (3, "e f g")])).toPandas()
    assert len(got) == 3 and got.kept.all()
    assert op.near_duplicates(documents(spark, odd_rows()).where("false")).count() == 0


def test_rows_without_an_id_are_compared(spark):
    """A class whose rows have no id, or share one, still meets its near duplicates."""
    base = prose(3, 150)
    near, far = edited(base, 0.01, 1), edited(base, 0.01, 2)
    rows = [(None, base), (5, near), (None, far), (None, prose(8, 100)), (9, base), (9, prose(10, 90)), (None, base)]
    got = op.near_duplicates(documents(spark, rows, extra=True)).toPandas()
    assert got[got.component_id == 5].shape[0] == 5 and got.kept.sum() == 3
    out = op.one_of_each(documents(spark, rows, extra=True))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == sorted([(5, near), (0, prose(8, 100)), (9, prose(10, 90))])


def test_one_of_many_copies_stays(spark):
    """Copies under one id, and a null that changes places with a text."""
    rows = [(7, prose(1, 60), None)] * 5 + [(7, None, prose(1, 60))] * 2 + [(8, prose(1, 60), "x")]
    out = op.one_of_each(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"] is None) for r in out) == [(7, False), (7, True), (7, True)]


def test_stars_of_more_than_one_unit(spark):
    """Six hundred near copies of one text: units of a few hundred, one component."""
    rows = [(i, edited(prose(2, 200), 0.004, i)) for i in range(600)]
    got = op.near_duplicates(documents(spark, rows)).toPandas()
    assert sorted(zip(got.doc_id, got.component_id, strict=True)) == [(a, c) for a, _, c in brute(rows)]


def test_pruning_keeps_pairs_at_the_threshold():
    """Signatures of pairs at the threshold pass every batch, far below the chosen miss in these draws."""
    p, steps = op.MinHash(), op.least_matches(op.MinHash())
    r = np.random.RandomState(1)
    a = r.randint(0, 1 << 16, (20_000, p.k)).astype(np.uint16)
    b = np.where(r.rand(*a.shape) < 0.85, a, a + 1)
    assert op._alive(a, b, steps).mean() > 0.9995
    far = np.where(r.rand(*a.shape) < 0.4, a, a + 1)
    assert op._alive(a, far, steps).mean() < 0.001


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "src long, dst long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
