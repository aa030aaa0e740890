"""Queries of retrieval: sparse and dense ranking, fusion, reranking, budget."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.operators import bm25, cells, dense, fusion, segments
from foliant.plans.text import mtok, tok, typed
from foliant.sources.scratch import folder, written
from foliant.sources.tables import table


def index(spark, d):
    """The saved index of the documents, made by the first query that needs it."""
    return bm25.kept(spark, f"{d}/documents.parquet", folder(spark))


def vectors(spark, d):
    return dense.kept(spark, f"{d}/documents.parquet", folder(spark))


def items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def best(spark, d, k=10):
    """The first k of every item, written: Spark sees how few they are and sends them to the documents, so that no text is shuffled."""
    return written(bm25.search(index(spark, d), items(spark, d), k), "best")


def ranked(found):
    return found.select("query_id", "doc_id", "score", "rank")


def bm25_stats(spark, d):
    index = bm25.build(table(spark, d, "documents"))
    df = index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    n = index.totals.select(F.col("documents").cast("double")).scalar()
    return df.select("term", "df", "cf", F.round(F.log((n + 1) / F.col("df")), 6).alias("idf"))


def bm25_topk(spark, d):
    return ranked(bm25.search(index(spark, d), items(spark, d)))


def bm25_scoped(spark, d):
    documents = table(spark, d, "documents")
    return ranked(bm25.search(index(spark, d), items(spark, d), scope=documents.where("source = 'src1'").select("doc_id")))


def bm25_incremental(spark, d):
    """Half of the corpus indexed first, the other half added; the ranking of the whole."""
    documents = table(spark, d, "documents")
    index = bm25.build(documents.where("doc_id % 2 = 0")).merge(bm25.build(documents.where("doc_id % 2 = 1")))
    return ranked(bm25.search(index, items(spark, d)))


def bm25_blockmax(spark, d):
    """The first ten of every question by block bounds, over one segment."""
    return ranked(segments.kept(spark, f"{d}/documents.parquet", folder(spark)).search(items(spark, d)))


def bm25_segments(spark, d):
    """Three adds, a delete, some documents again, and a compaction; the ranking of what is left."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    index = segments.SegmentedIndex(spark, f"{folder(spark)}/foliant/segments-{uuid.uuid4().hex}")
    index.add(documents.where("doc_id % 3 = 0"))
    index.add(documents.where("doc_id % 3 = 1"))
    index.delete(documents.where("doc_id % 7 = 0"))
    index.compact(all_of_them=True)
    index.add(documents.where("doc_id % 3 = 2 OR doc_id % 14 = 0"))
    index.delete(documents.where("doc_id % 11 = 0"))
    return ranked(index.search(items(spark, d)))


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").alias("scope"))
    return e, e.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")


def knn_topk(spark, d):
    return ranked(dense.nearest(*_vectors(spark, d)))


def knn_cells(spark, d):
    """The rows of ``knn_topk`` by the saved index of cells."""
    queries = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ranked(cells.kept(spark, f"{d}/embeddings.parquet", folder(spark)).search(queries))


def knn_scoped(spark, d):
    return ranked(dense.nearest(*_vectors(spark, d), scoped=True))


def dense_floor(spark, d):
    return ranked(dense.nearest(*_vectors(spark, d), floor=0.5))


def _dense_text(spark, d):
    return dense.nearest(vectors(spark, d), dense.embed(items(spark, d), "query_id"), exclude_self=False)


def hybrid(spark, d):
    return fusion.rrf([(_dense_text(spark, d), 0.5), (bm25.search(index(spark, d), items(spark, d)), 0.5)])


def embed_text(spark, d):
    v = dense.embed(table(spark, d, "documents"), "doc_id")
    return v.select("doc_id", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).cast("long").alias("n"), F.array_join(F.transform("vector", lambda x: x.cast("long")), ",").alias("buckets"))


def rrf_fuse(spark, d):
    a, b = dense.nearest(*_vectors(spark, d)), dense.nearest(*_vectors(spark, d), scoped=True)
    return ranked(fusion.rrf([(a, 1.0), (b, 1.0)]))


def rrf_weighted(spark, d):
    a, b = dense.nearest(*_vectors(spark, d)), dense.nearest(*_vectors(spark, d), scoped=True)
    return ranked(fusion.rrf([(a, 0.2), (b, 0.8)]))


def hybrid_retrieve(spark, d):
    return ranked(hybrid(spark, d))


def multi_query_fuse(spark, d):
    """Each question with two shorter variants, hybrid for each, fused, the first twenty."""
    words = F.split("text", " ")
    variants = items(spark, d).select(
        "query_id", F.posexplode(F.array("text", F.array_join(F.slice(words, 1, 8), " "), F.array_join(F.slice(F.reverse(words), 1, 8), " "))).alias("variant", "text")
    )
    flat = variants.select((F.col("query_id") * 3 + F.col("variant")).alias("query_id"), "text")
    # Written, as each list is read once for each variant.
    sparse = written(bm25.search(index(spark, d), flat), "sparse")
    near = written(dense.nearest(vectors(spark, d), dense.embed(flat, "query_id"), exclude_self=False), "near")
    each = fusion.rrf([(near, 0.5), (sparse, 0.5)])
    split = lambda v: each.where(F.pmod("query_id", F.lit(3)) == v).withColumn("query_id", F.expr("query_id div 3"))
    return ranked(fusion.rrf([(split(v), 1.0) for v in range(3)], most=20))


def rerank_topk(spark, d):
    return fusion.rerank(bm25.search(index(spark, d), items(spark, d)), items(spark, d), table(spark, d, "documents"))


def rerank_floor(spark, d):
    return fusion.rerank(bm25.search(index(spark, d), items(spark, d)), items(spark, d), table(spark, d, "documents"), floor=0.2)


def context_budget(spark, d):
    documents = table(spark, d, "documents")
    found = best(spark, d).join(documents.select("doc_id", F.length("text").alias("_n")), "doc_id")
    return fusion.within_budget(found, F.col("_n")).select("query_id", "doc_id", "rank", "used")


QUERIES = {f.__name__: f for f in (
    bm25_stats, bm25_topk, bm25_scoped, bm25_incremental, bm25_blockmax, bm25_segments, knn_topk, knn_cells, knn_scoped, dense_floor, embed_text, rrf_fuse, rrf_weighted,
    hybrid_retrieve, multi_query_fuse, rerank_topk, rerank_floor, context_budget,
)}


def bm25_ctes(questions: str = "SELECT item_id AS query_id, text FROM benchmark", p: str = "") -> str:
    """Scores of every document that shares a term: CTE ``{p}scores(query_id, doc_id, score)``."""
    return f"""
{p}q AS ({questions}),
{p}tok AS (SELECT doc_id, coalesce({tok('text')}, []) AS t FROM documents),
{p}stats AS (SELECT count(*)::DOUBLE AS n, sum(len(t)) / count(*) AS mean FROM {p}tok),
{p}post AS (SELECT doc_id, term, length, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM {p}tok) GROUP BY ALL),
{p}freq AS (SELECT term, count(*)::DOUBLE AS df, sum(tf)::BIGINT AS cf FROM {p}post GROUP BY term),
{p}terms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tok('text')}) AS term FROM {p}q) GROUP BY ALL),
{p}scores AS (SELECT query_id, doc_id, round(sum(ln((n + 1) / df) * qtf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)))), 6) AS score
  FROM {p}terms JOIN {p}freq USING (term) JOIN {p}post USING (term), {p}stats GROUP BY query_id, doc_id)"""


def first_k(source: str, k: int, ties: str = "doc_id") -> str:
    return f"SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ties}) AS rank FROM {source}) WHERE rank <= {k}"


_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"


def _knn(where: str = "") -> str:
    return first_k(f"(SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id {where})", 10)


def rrf_sql(lists: list[tuple[str, float]], most: int = 10**9, keys: str = "query_id") -> str:
    union = " UNION ALL ".join(f"SELECT {keys}, doc_id, rank, {i} AS list, {w}::DOUBLE AS w FROM ({s})" for i, (s, w) in enumerate(lists))
    return f"""SELECT * FROM (SELECT {keys}, doc_id, score, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, seen, doc_id) AS rank
  FROM (SELECT {keys}, doc_id, round(sum(w / (60 + rank)), 9) AS score, min(list * 1000000 + rank) AS seen FROM ({union}) GROUP BY {keys}, doc_id)) WHERE rank <= {most}"""


def dense_ctes(p: str = "") -> str:
    """Cosines of hashed token counts: CTE ``{p}near(query_id, doc_id, score)``; needs the CTEs of bm25_ctes."""
    b = "(('0x' || substring(md5(term), 1, 8))::BIGINT % 64)"
    return f"""
{p}dv AS (SELECT doc_id, {b} AS b, sum(tf)::DOUBLE AS n FROM {p}post GROUP BY ALL),
{p}qv AS (SELECT query_id, {b} AS b, sum(qtf)::DOUBLE AS n FROM {p}terms GROUP BY ALL),
{p}dn AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM {p}dv GROUP BY doc_id),
{p}qn AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM {p}qv GROUP BY query_id),
{p}near AS (SELECT qn.query_id, dn.doc_id, round(coalesce(s, 0) / (qn.norm * dn.norm), 6) AS score FROM {p}qn qn CROSS JOIN {p}dn dn
  LEFT JOIN (SELECT query_id, doc_id, sum(q.n * d.n) AS s FROM {p}qv q JOIN {p}dv d USING (b) GROUP BY ALL) x ON x.query_id = qn.query_id AND x.doc_id = dn.doc_id)"""


_F1 = f"""
pairs AS (SELECT r.query_id, r.doc_id, r.rank AS before, {mtok('q.text')} AS a, {mtok('d.text')} AS b FROM ranked r JOIN q USING (query_id) JOIN documents d USING (doc_id)),
ac AS (SELECT query_id, doc_id, t, count(*) AS n FROM (SELECT query_id, doc_id, unnest(a) AS t FROM pairs) GROUP BY ALL),
bc AS (SELECT query_id, doc_id, t, count(*) AS n FROM (SELECT query_id, doc_id, unnest(b) AS t FROM pairs) GROUP BY ALL),
common AS (SELECT query_id, doc_id, sum(least(ac.n, bc.n))::DOUBLE AS c FROM ac JOIN bc USING (query_id, doc_id, t) GROUP BY ALL),
f1 AS (SELECT p.query_id, p.doc_id, before, round(coalesce(2 * (c / len(a)) * (c / len(b)) / (c / len(a) + c / len(b)), 0), 6) AS score
  FROM pairs p LEFT JOIN common USING (query_id, doc_id))"""

_BM = f"WITH {bm25_ctes()}"
_TOP = first_k("scores", 10)
_HYBRID = rrf_sql([(first_k("near", 10), 0.5), (_TOP, 0.5)])
_VARIANTS = """SELECT item_id * 3 + v AS query_id, CASE v WHEN 0 THEN text WHEN 1 THEN array_to_string(string_split(text, ' ')[1:8], ' ')
  ELSE array_to_string(list_reverse(string_split(text, ' '))[1:8], ' ') END AS text FROM benchmark, (VALUES (0), (1), (2)) AS t(v)"""

SQL = {
    "bm25_stats": f"{_BM} SELECT term, df::BIGINT AS df, cf, round(ln((n + 1) / df), 6) AS idf FROM freq, stats",
    "bm25_topk": f"{_BM} {_TOP}",
    "bm25_scoped": f"{_BM} {first_k("(SELECT s.* FROM scores s JOIN documents USING (doc_id) WHERE source = 'src1')", 10)}",
    "bm25_incremental": f"{_BM} {_TOP}",
    "bm25_blockmax": f"{_BM} {_TOP}",
    "bm25_segments": f"WITH {bm25_ctes().replace('FROM documents', 'FROM documents WHERE doc_id % 11 <> 0 AND (doc_id % 3 = 2 OR doc_id % 7 <> 0 OR doc_id % 14 = 0)')} {_TOP}",
    "knn_topk": _knn(),
    "knn_cells": _knn(),
    "knn_scoped": _knn("AND a.label = b.label"),
    "dense_floor": f"SELECT * FROM ({_knn()}) WHERE score >= 0.5",
    "embed_text": f"""{_BM}, {dense_ctes()}
SELECT doc_id, sum(n)::BIGINT AS n, string_agg(n::BIGINT::VARCHAR, ',' ORDER BY b) AS buckets
FROM (SELECT doc_id, i.b, coalesce(v.n, 0) AS n FROM dn CROSS JOIN (SELECT unnest(range(64)) AS b) i LEFT JOIN dv v USING (doc_id, b)) GROUP BY doc_id""",
    "rrf_fuse": rrf_sql([(_knn(), 1.0), (_knn("AND a.label = b.label"), 1.0)]),
    "rrf_weighted": rrf_sql([(_knn(), 0.2), (_knn("AND a.label = b.label"), 0.8)]),
    "hybrid_retrieve": f"{_BM}, {dense_ctes()} {_HYBRID}",
    "multi_query_fuse": f"""WITH {bm25_ctes(_VARIANTS)}, {dense_ctes()}, each AS ({_HYBRID})
{rrf_sql([(f"SELECT query_id // 3 AS query_id, doc_id, rank FROM each WHERE query_id % 3 = {v}", 1.0) for v in range(3)], 20)}""",
    "rerank_topk": f"{_BM}, ranked AS ({_TOP}), {_F1} {first_k('f1', 5, 'before')}",
    "rerank_floor": f"{_BM}, ranked AS ({_TOP}), {_F1} {first_k('(SELECT * FROM f1 WHERE score >= 0.2)', 5, 'before')}",
    "context_budget": f"""{_BM}, ranked AS ({_TOP})
SELECT query_id, doc_id, rank, used FROM (SELECT query_id, doc_id, rank, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used
  FROM ranked JOIN documents USING (doc_id)) WHERE used <= 6000 OR rank = 1""",
}
SQL |= {name: typed(sql, rank="INTEGER") for name, sql in SQL.items() if name not in ("bm25_stats", "embed_text")}
