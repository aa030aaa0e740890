"""Rank fusion, reranking and context budgets over ranked lists."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from foliant.functions.text import metric_tokens

RRF_K = 60


def rrf(lists: list[tuple[DataFrame, float]], most: int | None = None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (``keys``, doc_id, rank).

    Equal scores rank by the list that saw the document first, then by its rank there."""
    every = reduce(
        DataFrame.unionByName,
        (d.select(*keys, "doc_id", "rank", F.lit(i).alias("list"), F.lit(float(w)).alias("w")) for i, (d, w) in enumerate(lists)),
    )
    fused = every.groupBy(*keys, "doc_id").agg(
        F.round(F.sum(F.col("w") / (RRF_K + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("_seen")
    )
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "_seen", "doc_id")
    out = fused.withColumn("rank", F.row_number().over(order)).drop("_seen")
    return out if most is None else out.where(F.col("rank") <= most)


def f1(a: Counter, b: Counter) -> float:
    """Token F1 of two multisets; 0 where they share nothing."""
    common = (a & b).total()
    if not common:
        return 0.0
    p, r = common / a.total(), common / b.total()
    return 2 * p * r / (p + r)


@F.pandas_udf(DoubleType())
def overlap_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    """Token F1 of two token arrays; counting in Catalyst would be quadratic in a text's length."""
    return pd.Series([f1(Counter(x), Counter(y)) for x, y in zip(a, b, strict=True)], dtype=float)


def rerank(candidates: DataFrame, queries: DataFrame, documents: DataFrame, k: int = 5, floor: float | None = None) -> DataFrame:
    """Candidates (query_id, doc_id, rank) scored again by token F1 of question and text; the floor comes before the cut."""
    q = queries.select("query_id", metric_tokens("text").alias("_q"))
    d = documents.select("doc_id", metric_tokens("text").alias("_d"))
    scored = candidates.select("query_id", "doc_id", F.col("rank").alias("_before")).join(q, "query_id").join(d, "doc_id")
    scored = scored.withColumn("score", F.round(overlap_f1(F.col("_q"), F.col("_d")), 6))
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "_before")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def within_budget(ranked: DataFrame, length: Column, most: int = 6000) -> DataFrame:
    """The longest prefix of each query's list whose lengths add up to ``most``; the first always stays."""
    upto = F.sum(length).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("used", upto).where((F.col("used") <= most) | (F.col("rank") == 1))
