import numpy as np
import pytest

from foliant.operators import dense


def vectors(spark, n, seed, key):
    r = np.random.RandomState(seed)
    rows = [(int(i), [float(x) for x in r.randint(-3, 4, 6)], "abc"[i % 3]) for i in range(n)] + [(n, [0.0] * 6, "a"), (0, [1.0] * 6, "b")]
    return spark.createDataFrame(rows, f"{key} long, vector array<double>, scope string")


def rows(found):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect())


@pytest.mark.parametrize("how", [{}, {"scoped": True}, {"floor": 0.6, "exclude_self": False}])
def test_blocks_on_executors_find_what_a_broadcast_finds(spark, monkeypatch, how):
    """Repeated ids, zero vectors and ties: the same rows, without a query on the driver."""
    corpus, queries = vectors(spark, 220, 1, "doc_id"), vectors(spark, 40, 2, "query_id")
    want = rows(dense.nearest(corpus, queries, k=4, **how))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 9)
    monkeypatch.setattr(dense, "CORPUS_BLOCK", 50)

    def never(*_):
        raise AssertionError("queries were sent to the driver")

    monkeypatch.setattr(dense, "_sent", never)
    assert rows(dense.nearest(corpus, queries, k=4, **how)) == want and len(want) > 50


def test_no_queries(spark):
    corpus, queries = vectors(spark, 20, 1, "doc_id"), vectors(spark, 5, 2, "query_id")
    assert dense.nearest(corpus, queries.where("false"), k=4).count() == 0 == dense.nearest(corpus.where("false"), queries, k=4).count()
