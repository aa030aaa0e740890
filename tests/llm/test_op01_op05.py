"""Classifiers: held-out accuracy, exact neighbours, defined results on odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliant.llm import op01_quality as q
from foliant.llm import op05_toxicity as x
from foliant.llm import textkernel as tk
from foliant.llm.labelled import examples
from foliant.llm.shared import held_out

from .data import documents, odd_rows, prose


def corpus(spark, mark, n=160):
    rows = []
    for i in range(n):
        t = prose(i, 60)
        rows.append((i, mark(t) if i % 4 == 0 else t))
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 1 if i % 4 == 0 else 0) for i in range(n)], "doc_id long, quality int, toxic int")
    return documents(spark, rows), labels


def test_quality_learns_and_scores(spark):
    docs, labels = corpus(spark, lambda t: " ".join(w + "###" for w in t.split()))
    p = q.Quality(weights=1 << 14, shards=2)
    out = held_out(F.col("doc_id"), 4, 2)
    w = q.fit(examples(docs, labels, "quality", ~out, p.examples, p.seed), p)
    got = q.score(docs, w, p).join(labels, "doc_id").where(out).toPandas()
    assert len(got) > 20 and ((got.score >= 0.7) == (got.quality == 1)).all()
    odd = q.score(documents(spark, odd_rows(), extra=True), w, p).toPandas()
    assert len(odd) == len(odd_rows()) and odd.score.between(0, 1).all()
    empty = odd[odd.doc_id.isin([4, 5, 6])].score
    assert empty.nunique() == 1  # the bias alone


def test_quality_without_labels(spark):
    docs, labels = corpus(spark, str, 8)
    p = q.Quality(weights=1 << 10)
    w = q.fit(examples(docs, labels.where("false"), "quality", F.lit(True), 10, 1), p)
    assert set(q.score(docs, w, p).toPandas().score) == {0.5}
    assert q.score(docs.where("false"), w, p).count() == 0


def test_sparse_dot_product_equals_vectors(spark):
    p = q.Quality(weights=1 << 12)
    w = np.random.RandomState(1).normal(size=p.weights + 1)
    text = prose(3, 50) + " ### one one two!!"
    (_, t), = tk.pieces(pa.array([text]))
    (i, v), = q._vectors(t, p)
    got = q.score(documents(spark, [(1, text)]), w.astype(np.float64), p).first()["score"]
    assert abs(got - round(1 / (1 + np.exp(-(w[i] @ v))), 6)) < 2e-6


def test_toxicity_neighbours_are_exact(spark):
    docs, labels = corpus(spark, lambda t: t + " idiot clown moron")
    p = x.Toxicity(block=7, k=5, least=1)
    index = x.fit(examples(docs, labels, "toxic", F.lit(True), p.examples, p.seed), p)
    index.open()
    dense = np.zeros((len(index.ids), len(index.kept)))
    dense[np.repeat(np.arange(len(index.ids)), np.diff(index.bounds)), index.term] = index.weight
    for at, t in tk.pieces(pa.array([prose(i, 40) + " clown" * (i % 3) for i in range(60)])):
        for term, weight in index.vectors(t):
            query = np.zeros(len(index.kept))
            query[term] = weight
            cosine = np.round(dense @ query, 9)
            want = sorted((-c, i) for i, c in enumerate(cosine.tolist()) if c > 0)[: p.k]
            got = index.nearest(term, weight)
            assert np.allclose([c for c, _ in want], [c for c, _ in got]) and [i for _, i in want] == [i for _, i in got]
    out = x.score(documents(spark, odd_rows() + [(99, "you idiot clown moron")], extra=True), index).toPandas().set_index("doc_id")
    assert out.loc[99].score > 0.7 and out.loc[99].cosine > 0 and out.loc[4].score < 0.3 and np.isnan(out.loc[4].evidence)


def languages(n):
    """Texts of four vocabularies, each with its own common words."""
    r = np.random.RandomState(3)
    for i in range(n):
        common, rare = [f"c{i % 4}x{j}" for j in range(6)], [f"r{i % 4}x{j}" for j in range(400)]
        yield " ".join([common[j] for j in r.zipf(1.6, 30) % 6] + [rare[j] for j in r.randint(0, 400, 25)] + ["idiot"] * (i % 9 == 0))


def test_toxicity_skips_blocks(spark):
    """Postings of blocks whose bound can't reach the k-th cosine are left alone, and the neighbours are those of all pairs."""
    rows = list(enumerate(languages(900)))
    known = documents(spark, rows).selectExpr("doc_id", "text", "int(doc_id % 9 = 0) AS label")
    p = x.Toxicity(block=16, k=5, round=2)
    index = x.fit(known, p)
    index.open()
    dense = np.zeros((len(index.ids), len(index.kept)))
    dense[np.repeat(np.arange(len(index.ids)), np.diff(index.bounds)), index.term] = index.weight
    for _, t in tk.pieces(pa.array(list(languages(120))[::-1])):
        for term, weight in index.vectors(t):
            cosine = np.round(dense[:, term] @ weight, 9)
            best = sorted(((-c, i) for i, c in enumerate(cosine.tolist()) if c > 0))[: p.k]
            got = index.nearest(term, weight)
            assert np.allclose([c for c, _ in got], [c for c, _ in best], atol=2e-9) and {i for _, i in got} == {i for _, i in best}
    assert 0 < index.visited < 0.6 * index.asked and index.asked == 120 * index.blocks
    holders = np.bincount(index.term, minlength=len(index.kept))
    assert (holders < 9).sum() > 100  # terms of less than a hundredth of the examples are kept


def test_toxicity_without_labels(spark):
    docs, labels = corpus(spark, str, 8)
    index = x.fit(examples(docs, labels.where("false"), "toxic", F.lit(True), 10, 1), x.Toxicity())
    assert set(x.score(docs, index).toPandas().score) == {0.0}


def test_toxicity_keeps_clean_examples_and_all_terms(spark):
    """A clean text finds its clean example, and a toxic text without a word of the toxic class its toxic one."""
    docs, labels = corpus(spark, lambda t: t + " idiot clown moron")
    p = x.Toxicity(least=1)
    index = x.fit(examples(docs, labels, "toxic", F.lit(True), p.examples, p.seed), p)
    assert len(index.ids) == 160 and (index.label == 0).sum() == 120
    got = x.score(documents(spark, [(7, prose(7, 60)), (8, prose(8, 60))]), index).toPandas().set_index("doc_id")
    assert got.loc[7].evidence == 7 and got.loc[7].cosine > 0.999 and got.loc[8].evidence == 8


def test_sample_is_bounded_for_any_ids(spark):
    """Half of the rows share one id, ids repeat in both tables, labels conflict: never more rows than the bound."""
    rows = [(0 if i % 2 else i, f"text {i}") for i in range(4000)]
    labels = [(i, i % 2, 0) for i in range(0, 4000, 2)] + [(0, 1, 0), (0, 1, 0)] + [(2, 0, 1), (2, 1, 0), (None, 1, 0)]
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for seed in range(4):
        for bound in (100, 1000, 10_000):
            got = examples(docs, known, "quality", F.lit(True), bound, seed).toPandas()
            assert len(got) == min(bound, got.doc_id.nunique()) and got.doc_id.is_unique and (2 not in set(got.doc_id))
    every = examples(docs, known, "quality", F.lit(True), 10_000, 1).toPandas()
    assert len(every) == 1998 and every[every.doc_id == 0].empty == (True)  # id 0 has labels 0 and 1


def words_of(text):
    """Runs of letters and digits, and runs of symbols, in order."""
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]+", text)


def test_quality_features_against_python():
    """The same n-grams, counted by their strings, must fall together and apart as the hashed ones do."""
    size = 1 << 40  # no collisions
    texts = ["a b a b a b.", "One two!! three 4 FIVE five five", "", "x", "# ## é été ÉTÉ\nnext line, next line, next line"]
    for at, t in tk.pieces(pa.array(texts)):
        index, doc = q.features(t, size)
        for i in range(t.n):
            w = words_of(texts[at + i])
            plain = lambda x: bool(re.match(r"[0-9A-Za-z\x80-\U0010ffff]", x))

            def shape(k, w=w, plain=plain):
                x, upper = w[k], "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
                long = len(x.encode()) > 1
                kind = (5 if long else 4) if not plain(x) else 3 if x[0] in "0123456789" else (2 if long and x[-1] in upper else 1) if x[0] in upper else 0
                return kind * 2 + (plain(x) and x in w[max(0, k - 2) : k])

            pairs = list(zip(w, w[1:]))  # noqa: B905
            triples = list(zip(w, w[1:], w[2:]))  # noqa: B905
            shapes = [tuple(map(shape, range(k, k + 3))) for k in range(len(w) - 2)]
            again = sum(triples[:k].count(x) > 0 for k, x in enumerate(triples))
            want = Counter(Counter([("w", x) for x in w] + [("p", x) for x in pairs] + [("s", x) for x in shapes] + [("a", 0)] * again).values())
            assert Counter(Counter(index[doc == i].tolist()).values()) == want


def test_ftrl_steps_against_python():
    """FTRL-proximal coordinate by coordinate, in plain Python."""
    p = q.Quality(weights=30, epochs=3, alpha=0.3, l1=0.02, l2=0.1)
    r = np.random.RandomState(4)
    rows = [(np.append(np.sort(r.choice(30, 5, replace=False)), 30), np.append(r.rand(5) * 3, 1.0), int(r.rand() < 0.5)) for _ in range(25)]
    z, n = [0.0] * 31, [0.0] * 31

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    order = np.random.RandomState(p.seed)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            index, x, y = rows[k]
            w = [weight(i) for i in index]
            loss = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - y
            for i, v, wi in zip(index, x, w, strict=True):
                g = loss * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i] += g - sigma * wi
                n[i] += g * g
    assert np.allclose(q._train(rows, p), [weight(i) for i in range(31)], atol=1e-12)


def test_toxicity_end_to_end_against_python(spark):
    """Terms, TF-IDF, cosine, neighbours and votes of whole texts recomputed from strings."""
    docs, labels = corpus(spark, lambda t: t + " idiot clown clown moron", 60)
    p = x.Toxicity(block=7, k=4, least=3, shrink=5.0)
    index = x.fit(examples(docs, labels, "toxic", F.lit(True), p.examples, p.seed), p)
    known = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}

    def terms(text):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        return Counter(w) + Counter(("stem", k, x.encode()[:k]) for x in w for k in p.stems if len(x.encode()) > k)

    counts = {i: terms(t) for i, t in known.items()}
    df = Counter(t for c in counts.values() for t in c)
    kept = {t: math.log((60 + 1) / (n + 0.5)) * n / (n + 5) for t, n in df.items() if n >= 3}

    def vector(c):
        v = {t: n * kept[t] for t, n in c.items() if t in kept}
        norm = math.sqrt(sum(a * a for a in v.values()))
        return {t: a / norm for t, a in v.items()}

    vectors = {i: vector(c) for i, c in counts.items()}
    asked = [(500 + i, prose(i, 30) + (" clown idiot" if i % 2 else "")) for i in range(12)]
    got = x.score(documents(spark, asked), index).toPandas().set_index("doc_id")
    assert len(index.kept) == len(kept)
    for i, text in asked:
        v = vector(terms(text))
        cosine = {e: round(sum(a * u.get(t, 0.0) for t, a in v.items()), 9) for e, u in vectors.items()}
        best = sorted((c for c in cosine.values() if c > 0), reverse=True)[: p.k]
        assert abs(got.loc[i].cosine - best[0]) < 2e-6
        (_, t), = tk.pieces(pa.array([text]))
        vote, _, _ = index.vote(*index.vectors(t)[0])
        near = sorted(cosine, key=lambda e: -cosine[e])[: p.k]
        want = sum(cosine[e] * toxic[e] for e in near) / sum(cosine[e] for e in near)
        if len({cosine[e] for e in sorted(cosine, key=lambda e: -cosine[e])[: p.k + 1]}) == p.k + 1:  # no tie at the edge
            assert abs(vote - want) < 1e-6
