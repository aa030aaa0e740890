"""The index of vectors in cells finds what a scan finds, and reads less."""

import numpy as np
import pytest

from foliant.operators import cells, dense


def frame(spark, x, key, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], f"{key} long, vector array<double>")


def clustered(n, seed, spread=0.05):
    r = np.random.RandomState(7)
    centres = r.randn(12, 16)
    r = np.random.RandomState(seed)
    return centres[r.randint(0, 12, n)] + spread * r.randn(n, 16)


def rows(found):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect())


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    corpus = frame(spark, clustered(3000, 1), "doc_id")
    return corpus, cells.build(corpus, str(tmp_path_factory.mktemp("cells") / "index"), sample=1000)


def test_clusters_are_left_out_and_nothing_is_lost(spark, held, monkeypatch):
    corpus, index = held
    queries = frame(spark, clustered(40, 2), "query_id")
    want = rows(dense.nearest(corpus, queries, k=5))

    def never(*_, **__):
        raise AssertionError("the whole corpus was scanned")

    monkeypatch.setattr(dense, "nearest", never)
    assert rows(index.search(queries, k=5)) == want and len(want) == 200
    first = index.scored(index.probed(queries, 6, 2), 5)
    assert first.count() and index.work(index.probed(queries, 6, 2)) < 0.2 * 40 * 3000


def test_every_vector_is_in_one_ring_within_its_angles(spark, held):
    corpus, index = held
    kept = spark.read.parquet(f"{index.path}/vectors")
    assert kept.count() == corpus.count() == int(index.map.n.sum()) and kept.select("doc_id").distinct().count() == 3000
    x = np.random.RandomState(3).randn(20, 16)
    q = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = index.map.bounds(q)
    at = {(c, r): i for i, (c, r) in enumerate(zip(index.map.cell, index.map.ring, strict=True))}
    for row in kept.collect():
        v = np.array(row["vector"]) / np.linalg.norm(row["vector"])
        assert (q @ v <= best[:, at[row["cell"], row["ring"]]] + 1e-7).all()


def test_recall_of_the_first_pass(spark, held):
    corpus, index = held
    queries = frame(spark, clustered(60, 5), "query_id")
    exact = dense.nearest(corpus, queries, k=10)
    assert cells.recall(index.search(queries, k=10, probes=24, exact=False), exact) >= 0.9


@pytest.mark.parametrize("unit", [7, cells.UNIT])
def test_ties_zeros_copies_and_broken_vectors(spark, tmp_path, monkeypatch, unit):
    """A third of all rows are copies; rings and queries are dealt to many tasks; repeated ids and zero vectors count as in a scan."""
    monkeypatch.setattr(cells, "UNIT", unit)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 9 if unit == 7 else dense.QUERY_BLOCK)
    r = np.random.RandomState(1)
    x = [*r.randint(-2, 3, (80, 4)).astype(float), *[np.array([1.0, 2, 0, 1])] * 40, np.zeros(4), np.zeros(4)]
    ids = [*range(len(x) - 1), 0]
    good = frame(spark, x, "doc_id", ids)
    odd = frame(spark, [None, [], [1.0, float("nan"), 0, 0], [float("inf"), 0, 0, 1.0]], "doc_id", range(900, 904))
    index = cells.build(good.unionByName(odd), str(tmp_path / "index"))
    queries = frame(spark, [*r.randint(-2, 3, (25, 4)).astype(float), np.zeros(4), [1.0, 2, 0, 1]], "query_id")
    broken = frame(spark, [None, [1.0, float("nan"), 0, 0]], "query_id", (901, 902))
    monkeypatch.setattr(cells, "WORTH", 2.0)
    assert rows(index.search(queries.unionByName(broken), k=6)) == rows(dense.nearest(good, queries, k=6))


def test_nothing_to_find(spark, tmp_path):
    none = frame(spark, [], "doc_id")
    queries = frame(spark, [[1.0, 0.0]], "query_id")
    assert cells.build(none, str(tmp_path / "none")).search(queries).count() == 0
    zeros = cells.build(frame(spark, [[0.0, 0.0]] * 3, "doc_id"), str(tmp_path / "zeros"))
    assert rows(zeros.search(queries, k=2)) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]
    assert zeros.search(queries.where("false")).count() == 0


def test_where_bounds_save_nothing_blocks_meet(spark, tmp_path):
    """Vectors without any structure: the same rows, by a scan."""
    corpus, queries = frame(spark, np.random.RandomState(1).randn(300, 24), "doc_id"), frame(spark, np.random.RandomState(2).randn(10, 24), "query_id")
    index = cells.build(corpus, str(tmp_path / "index"))
    assert rows(index.search(queries, k=4)) == rows(dense.nearest(corpus, queries, k=4))
