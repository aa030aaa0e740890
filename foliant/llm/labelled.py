"""Labelled rows to learn from: split by hash of the id, bounded by a documented number whatever the ids are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def examples(documents: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int, seed: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most ``bound`` rows to learn from, one for each id.

    Ids whose labels conflict teach nothing, repeated labels count once.  Of more
    ids than the bound the first by hash stay: a top-k, of two numbers a row, which
    is broadcast, so the scan of the texts drops all others before anything moves.
    Of an id's texts the one of least hash stands for it; repeats are folded where
    they are read."""
    known = labels.where(F.col(label).isin(0, 1) & learn).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("_most")).where("label = _most and doc_id is not null")
    known = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(bound).select("doc_id", "label")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t")))
    return texts.groupBy("doc_id", "label").agg(one.alias("x")).select("doc_id", F.col("x.t").alias("text"), "label")
