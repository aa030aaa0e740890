"""Exact nearest neighbours for sets of query vectors, and a model-free text embedder.

A set of queries of checked size travels to the partitions of the corpus; each
partition keeps its own best k per query, so what is shuffled is k rows per
query and partition, never pairs.  A larger set never sees the driver: blocks of
queries and blocks of the corpus meet on the executors, each pair of blocks in
one group of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.operators.bm25 import top_k
from foliant.sources.scratch import once, version

#: Query vectors that are sent out; of more, so many are in a block.
QUERY_BLOCK = 4096
#: Corpus vectors that a block of queries meets at a time.
CORPUS_BLOCK = 32_768


def _stacked(column, d: int | None = None) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1 if d is None else d)


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 10, scoped: bool = False, floor: float | None = None, exclude_self: bool = True) -> DataFrame:
    """query_id, doc_id, score (cosine, 6 digits) and rank of the k nearest vectors of each query.

    ``corpus`` has doc_id, vector (and scope), ``queries`` query_id, vector (and scope).
    With ``scoped`` only vectors of the query's scope compete.  ``floor`` drops
    neighbours below it.  Zero vectors have cosine 0."""
    scope = ["scope"] if scoped else []
    corpus, queries = corpus.select(F.col("doc_id").cast("long"), "vector", *scope), queries.select("query_id", "vector", *scope)
    rule = _Rule(k, scoped, exclude_self)
    asked = queries.count()
    found = _sent(corpus, queries, rule) if asked <= QUERY_BLOCK else _met(corpus, queries, rule, -(-asked // QUERY_BLOCK))
    return top_k(found if floor is None else found.where(F.col("score") >= floor), k)


_FOUND = "query_id long, doc_id long, score double"


@dataclass(frozen=True)
class _Rule:
    """What competes, and how many stay."""

    k: int
    scoped: bool
    exclude_self: bool


class _Best:
    """The best k of each query so far, over batches of the corpus."""

    def __init__(self, queries: pa.Table, rule: _Rule):
        self.rule, self.ids = rule, queries.column("query_id").to_numpy()
        self.vectors = _unit(_stacked(queries.column("vector").combine_chunks()))
        self.scopes = np.array(queries.column("scope").to_pylist(), object) if rule.scoped else None
        self.scores, self.docs = np.full((len(self.ids), 0), 0.0), np.zeros((len(self.ids), 0), np.int64)

    def meet(self, batch: pa.RecordBatch) -> None:
        doc = batch.column(0).to_numpy()
        s = np.round(self.vectors @ _unit(_stacked(batch.column(1))).T, 6) + 0.0
        if self.rule.scoped:
            s[self.scopes[:, None] != np.array(batch.column(2).to_pylist(), object)[None, :]] = -np.inf
        if self.rule.exclude_self:
            s[self.ids[:, None] == doc[None, :]] = -np.inf
        s, d = np.concatenate([self.scores, s], 1), np.concatenate([self.docs, np.broadcast_to(doc, s.shape)], 1)
        keep = np.lexsort((d, -s), axis=1)[:, : self.rule.k]
        self.scores, self.docs = np.take_along_axis(s, keep, 1), np.take_along_axis(d, keep, 1)

    def columns(self) -> dict[str, pa.Array]:
        i, j = np.nonzero(np.isfinite(self.scores))
        return {"query_id": pa.array(self.ids[i]), "doc_id": pa.array(self.docs[i, j]), "score": pa.array(self.scores[i, j])}


def _sent(corpus: DataFrame, queries: DataFrame, rule: _Rule) -> DataFrame:
    """The best of each partition for at most QUERY_BLOCK queries, which are broadcast."""
    shared = corpus.sparkSession.sparkContext.broadcast(queries.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shared.value.num_rows:
            return
        best = _Best(shared.value, rule)
        for batch in batches:
            if batch.num_rows:
                best.meet(batch)
        yield pa.RecordBatch.from_pydict(best.columns())

    return corpus.mapInArrow(run, _FOUND)


def _met(corpus: DataFrame, queries: DataFrame, rule: _Rule, blocks: int) -> DataFrame:
    """The best of each pair of blocks: queries are copied for every block of the corpus and the corpus for every block of queries."""
    parts = max(1, -(-corpus.count() // CORPUS_BLOCK))
    number = lambda key, n: F.pmod(F.xxhash64(key, "vector"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("_q", number("query_id", blocks)).withColumn("_c", every(parts))
    right = corpus.withColumn("_c", number("doc_id", parts)).withColumn("_q", every(blocks))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        best = _Best(asked, rule)
        for batch in held.to_batches(max_chunksize=1024):
            best.meet(batch)
        return pa.table(best.columns())

    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(run, _FOUND)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def bucket(term, dimensions: int):
    """Bucket of a term by its MD5, the same in any engine."""
    return (F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def embed(documents: DataFrame, key: str, text: str = "text", dimensions: int = 64) -> DataFrame:
    """``key`` and vector: token counts by hashed bucket, a deterministic stand-in for a model."""
    terms = documents.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, bucket(F.col("term"), dimensions).alias("b")).agg(F.count("*").cast("double").alias("n"))
    held = terms.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    return held.select(key, at.alias("vector"))


def kept(spark: SparkSession, path: str, shared: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and vector of the table at ``path``, made once for each state of its files, below the folder ``shared``."""
    where = f"{shared}/vectors-{version(spark, path, key, text)}"
    once(spark, where, lambda to: embed(spark.read.parquet(path), key, text).write.parquet(to))
    return spark.read.parquet(where)


#: Fixed value: what stands before a question that is embedded, for models that expect it.
INSTRUCTION = "Represent this sentence for searching relevant passages: "


def embed_questions(questions: DataFrame, key: str, text: str = "text", instruction: str = INSTRUCTION) -> DataFrame:
    """``key`` and vector of questions, the instruction before each, once."""
    return embed(questions.select(key, F.concat(F.lit(instruction), text).alias("_asked")), key, "_asked")


def embed_with_header(chunks: DataFrame, key: str, header: str, text: str = "text") -> DataFrame:
    """``key`` and vector of chunks with their header on a line before; each row keeps its own, and blank ones have none."""
    whole = F.concat_ws("\n", F.nullif(F.col(header), F.lit("")), F.col(text))
    return embed(chunks.where(F.trim(text) != "").select(key, whole.alias("_whole")), key, "_whole")
