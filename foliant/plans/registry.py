"""Named queries of the core engine, each with the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import dialogue as talk
from foliant.operators import fusion
from foliant.sources.tables import table

from . import answers, dialogue, evaluation, pages, quality, redaction, retrieval, streams, text

FAMILIES = (text, pages, quality, retrieval, redaction, dialogue, evaluation, streams, answers)

QUERIES: dict = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for family in FAMILIES for name, sql in family.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a question: hybrid retrieval, reranking, budget, citations."""
    documents, questions = table(spark, sf_dir, "documents"), retrieval.items(spark, sf_dir)
    best = fusion.rerank(retrieval.hybrid(spark, sf_dir), questions, documents)
    rows = best.join(documents.select("doc_id", "source", F.col("text").alias("content")), "doc_id")
    kept = fusion.within_budget(rows, F.length("content"))
    chunks = kept.select(
        "query_id", "rank", "score", F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), F.concat("source", F.lit(".txt")).alias("filename"), "content"
    )
    return talk.citations(chunks)
