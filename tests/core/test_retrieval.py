import math
import random

import numpy as np
from pyspark.sql import functions as F

from foliant.operators import bm25, dense, fusion
from foliant.operators import dialogue as D
from foliant.operators import evaluate as E


def corpus(spark):
    return spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue sky and red sun red"), (4, None), (5, "apple apple apple")], "doc_id long, text string")


def test_bm25_by_hand(spark):
    q = spark.createDataFrame([(0, "red apple red")], "query_id long, text string")
    got = {r["doc_id"]: r["score"] for r in bm25.search(corpus(spark), q).collect()}
    texts = {1: "red apple pie", 2: "green apple", 3: "blue sky and red sun red", 4: "", 5: "apple apple apple"}
    docs = {i: t.split() for i, t in texts.items()}
    mean = sum(map(len, docs.values())) / 5
    want = {}
    for i, d in docs.items():
        s = 0.0
        for t, qtf in (("red", 2), ("apple", 1)):
            df, tf = sum(t in x for x in docs.values()), d.count(t)
            s += qtf * math.log(6 / df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean))
        if s:
            want[i] = round(s, 6)
    assert got == want


def test_index_grows_saves_and_scopes(spark, tmp_path):
    c, q = corpus(spark), spark.createDataFrame([(0, "red apple")], "query_id long, text string")
    index = bm25.build(c.where("doc_id < 3")).merge(bm25.build(c.where("doc_id >= 3")))
    index.save(str(tmp_path / "index"))
    again = bm25.score(bm25.Index.load(spark, str(tmp_path / "index")), bm25.query_terms(q)).collect()
    whole = bm25.search(c, q).collect()
    assert {(r["doc_id"], r["score"]) for r in again} == {(r["doc_id"], r["score"]) for r in whole}
    scoped = bm25.search(c, q, scope=c.where("doc_id = 2").select("doc_id")).collect()
    assert [(r["doc_id"], r["score"]) for r in scoped] == [(r["doc_id"], r["score"]) for r in whole if r["doc_id"] == 2]


def test_nearest_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    r = np.random.RandomState(1)
    v = r.normal(size=(80, 6))
    v[5] = v[9]
    v[11] = 0
    df = spark.createDataFrame([(i, x.tolist(), f"g{i % 3}") for i, x in enumerate(v)], "doc_id long, vector array<double>, scope string").repartition(5)
    q = df.where("doc_id < 8").withColumnRenamed("doc_id", "query_id")
    n = np.sqrt((v * v).sum(1))
    u = v / np.where(n > 0, n, 1)[:, None]
    for scoped, floor in ((False, None), (True, None), (False, 0.3)):
        got = {}
        for x in dense.nearest(df, q, 4, scoped, floor).collect():
            got.setdefault(x["query_id"], []).append((x["rank"], x["doc_id"]))
        for i in range(8):
            s = [(-round(float(u[i] @ u[j]), 6), j) for j in range(80) if j != i and (not scoped or i % 3 == j % 3)]
            want = [j for c, j in sorted(s)[:4] if floor is None or -c >= floor]
            assert [d for _, d in sorted(got.get(i, []))] == want


def test_rrf_weights_and_ties(spark):
    mk = lambda ids: spark.createDataFrame([(0, d, i + 1) for i, d in enumerate(ids)], "query_id long, doc_id long, rank int")
    order = lambda w1, w2: [r["doc_id"] for r in fusion.rrf([(mk([1, 2, 3]), w1), (mk([3, 4, 5]), w2)]).orderBy("rank").collect()]
    assert order(1, 1) == [3, 1, 2, 4, 5] and order(0.1, 0.9)[:2] == [3, 4] and order(0.9, 0.1)[:2] == [3, 1]


def test_budget_keeps_a_prefix_and_the_first(spark):
    rows = spark.createDataFrame([(0, 1, 7000), (0, 2, 10), (1, 1, 3000), (1, 2, 2900), (1, 3, 200), (1, 4, 1)], "query_id long, rank int, n int")
    got = {(r["query_id"], r["rank"]) for r in fusion.within_budget(rows, F.col("n")).collect()}
    assert got == {(0, 1), (1, 1), (1, 2)}


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(0, d, d) for d in range(1, 11)] + [(1, 5, 1)], "query_id long, doc_id long, rank int")
    gold = spark.createDataFrame([(0, 2), (0, 5), (0, 99)], "query_id long, doc_id long")
    got = {r["query_id"]: r for r in E.ranking(ranked, gold).collect()}
    m = got[0]
    dcg, ideal = 1 / math.log2(3) + 1 / math.log2(6), 1 + 1 / math.log2(3)
    assert (m["precision_at_k"], m["recall_at_k"], m["mrr_at_k"]) == (0.2, round(2 / 3, 6), 0.5)
    assert m["ndcg_at_k"] == round(dcg / ideal, 6) and m["average_precision"] == round((1 / 2 + 2 / 5) / 3, 6)
    assert got[1]["ndcg_at_k"] == got[1]["recall_at_k"] == 0.0 and got[1]["first_hit"] is None


def test_containment_against_a_scan(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(60)]
    items = [(i, " ".join(docs[i * 3][1].split()[10:15])) for i in range(15)] + [(90, "w1 w2 w3 nowhere")]
    got = {tuple(x) for x in E.containment(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, text string")).collect()}
    assert got == {(q, d) for q, t in items for d, x in docs if t in x}


def test_citations_keep_the_first_on_ties(spark):
    rows = [(0, 1, 0.5, "a", "3", "a.txt", "first"), (0, 2, 0.5, "a", "3", "a.txt", "second"), (0, 3, 0.9, "b", "3", "b.txt", "other"), (0, 4, 1.0, "c", "n/a", "c.txt", "bad page")]
    got = D.citations(spark.createDataFrame(rows, "query_id long, rank int, score double, document_id string, page_number string, filename string, content string")).orderBy("n").collect()
    assert [(r["document_id"], r["page_number"], r["snippet"]) for r in got] == [("b", 3, "other"), ("a", 3, "first")]


def test_history_limits(spark):
    talk = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f" t{i} ") for i in range(8)] + [(1, 9, "system", "x"), (1, 10, "user", "  ")], "conv_id long, turn long, role string, text string")
    assert [r["turn"] for r in D.history(talk, 3).orderBy("turn").collect()] == [5, 6, 7]
    assert D.history(talk, 0).count() == 0 and D.history(talk, -1).count() == 8


def test_a_state_is_told_from_the_files_of_all_folders(spark, tmp_path):
    """A file that joins the innermost folder of a table with two partition columns is a new state."""
    from foliant.sources.scratch import version

    rows = spark.createDataFrame([(1, "one", 0, 0), (2, "two", 0, 1), (3, "three", 1, 0)], "doc_id long, text string, a int, b int")
    path = str(tmp_path / "nested")
    rows.write.partitionBy("a", "b").parquet(path)
    before = version(spark, path, "text")
    assert version(spark, path, "text") == before != version(spark, path, "other")
    spark.createDataFrame([(4, "four")], "doc_id long, text string").write.mode("append").parquet(f"{path}/a=0/b=0")
    assert version(spark, path, "text") != before
