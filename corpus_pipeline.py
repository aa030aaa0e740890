"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Every stage takes and, but for the last, returns the columns of ``documents``;
what it returns is written as Parquet and read again as the next one's input.
Tables that a stage wrote on its way are deleted when one further down the list
begins, unless that one's input still reads them; those of the last stage stay.

Edge cases: a null or empty text fails the quality rules and goes; a null or
repeated doc_id, a null lang or source and equal rows are judged row by row
(rows are told apart by their place, never by what they hold); of equal rows one
stays after near-dedup; extra columns are carried along whatever their names; an
empty table gives empty stages and no pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.op03_fertility import accepted
from foliant.llm.op06_minhash import MinHash, one_of_each
from foliant.llm.op07_packing import pack
from foliant.llm.op09_secrets import mask_secrets
from foliant.llm.op10_mixture import mixed_documents
from foliant.llm.shared import discard, reads, recorded, table, written

#: Near-duplicates of the pipeline: five-word shingles, similarity 0.8 or more.
NEAR = MinHash(shingle_words=5, percent=80, bands=32, rows=6)

_left: list[tuple[int, DataFrame]] = []  # tables that stages wrote on their way, with the stage's place


def _stage(place: int) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[SparkSession, DataFrame, str], DataFrame]]:
    """The stage at ``place``, which first clears what those before it left."""

    def stage(do: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
        @wraps(do)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for entry in [(at, t) for at, t in _left if at < place and not reads(docs, t._foliant_folder)]:
                discard(entry[1])
                _left.remove(entry)
            with recorded() as tables:
                out = do(docs)
            if place < len(STAGES) - 1:
                _left.extend((place, t) for t in tables)
            return out

        return run

    return stage


@_stage(0)
def quality_rules(docs: DataFrame) -> DataFrame:
    """Documents that fail the base rule or lie outside the tokeniser bands go."""
    return accepted(docs)


@_stage(1)
def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs, NEAR)


@_stage(2)
def secret_scan(docs: DataFrame) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays."""
    return mask_secrets(docs)


@_stage(3)
def mix_sources(docs: DataFrame) -> DataFrame:
    """The words that the mix takes of each document, once per pass over its source."""
    return mixed_documents(docs)


@_stage(4)
def packing(docs: DataFrame) -> DataFrame:
    """Pieces of packed sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

#: Tokenisers, sketches and permutations are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        docs = last = out
    return STAGES[-1][1](spark, docs, sf_dir)
