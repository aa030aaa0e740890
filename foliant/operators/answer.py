"""From ranked chunks to what a model is given, and what is said when there is nothing to give.

Text that has been scrubbed carries a mark in its column's metadata.  What
builds inputs for a model takes marked columns only, and scrubbing a marked
column again changes nothing.  Models are functions of a text column that the
caller brings; without one, or where one fails, the original text stands.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.functions.text import strip
from foliant.operators.dialogue import transcript, turns
from foliant.operators.redact import with_carry

MARK = {"scrubbed": True}

#: What is said without context, and why.
NO_CONTEXT = "The answer is not available in the uploaded documents. Please ask about information contained in the uploaded documents."
NOTHING_UPLOADED = "No documents are uploaded yet."
UNKNOWN_DOCUMENT = "The selected document is no longer available."
NO_MATCH_IN_DOCUMENT = "No matching context in the selected document."

#: The frame of a question with its context, and of a summary.
PROMPT = ("Question: ", "\n\nRetrieved context:\n<context>\n", "\n</context>")
SUMMARY = "\n\nConversation summary so far (older turns that are no longer shown verbatim):\n"


def is_scrubbed(rows: DataFrame, column: str) -> bool:
    return bool(rows.schema[column].metadata.get("scrubbed"))


def scrubbed(rows: DataFrame, column: str, scrub: Callable[[Column], Column]) -> DataFrame:
    """``column`` scrubbed and marked; a marked one stays as it is."""
    if is_scrubbed(rows, column):
        return rows
    return rows.withColumn(column, scrub(F.col(column))).withMetadata(column, MARK)


def require_scrubbed(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows``, if all these columns are marked; an error before any work otherwise."""
    raw = [c for c in columns if not is_scrubbed(rows, c)]
    if raw:
        raise ValueError(f"not scrubbed: {', '.join(raw)}")
    return rows


def prompts(rows: DataFrame, question: str, context: str, system: str = "", summary: str | None = None) -> DataFrame:
    """Adds system and prompt, of scrubbed columns only; an empty or missing ``summary`` adds nothing to the system text."""
    taken = require_scrubbed(rows, question, context, *([summary] if summary else []))
    more = F.when(F.coalesce(F.col(summary), F.lit("")) != "", F.concat(F.lit(SUMMARY), summary)).otherwise("") if summary else F.lit("")
    before, between, after = map(F.lit, PROMPT)
    return taken.withColumn("system", F.concat(F.lit(system), more)).withColumn("prompt", F.concat(before, question, between, context, after))


def model_inputs(questions: DataFrame, ranked: DataFrame, scrub: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """What a model is given of each question, and the scrubbed text of each page that it is given.

    ``questions(query_id, text)``, ``ranked(query_id, rank, document_id, filename,
    page_number, content)``; ``scrub`` takes a text and what stands before it: the
    end of the chunk ranked before, or of the question.  Labels come from the
    table, never from scrubbed text.  Returns (query_id, question, context) and
    (query_id, document_id, page_number, text)."""
    rows = ranked.select("query_id", "rank", "document_id", "filename", "page_number", "content")
    asked = questions.select("query_id", F.lit(0).alias("rank"), *(F.lit(None).cast("string").alias(c) for c in ("document_id", "filename", "page_number")), F.col("text").alias("content"))
    every = with_carry(rows.withColumn("page_number", F.col("page_number").cast("string")).unionByName(asked), "query_id", "rank", "content")
    every = every.withColumn("content", scrub(F.col("content"), F.col("carry"))).drop("carry").withMetadata("content", MARK)
    name = F.coalesce("filename", "document_id")
    page = F.concat(F.lit("Page "), F.coalesce("page_number", F.lit("?")), F.lit("]\n"))
    block = F.concat(F.when(name.isNull(), F.lit("[")).otherwise(F.concat(F.lit("[Doc: "), name, F.lit(" | "))), page, "content")
    ordered = lambda value, then: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 0, F.struct("rank", value.alias("v"))))), lambda x: x["v"]), then)
    whole = every.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 0, F.col("content"))).alias("question"), ordered(block, "\n\n").alias("context"))
    by_page = every.where("rank > 0").groupBy("query_id", "document_id", "page_number").agg(ordered(F.col("content"), "\n").alias("text"))
    return whole.withMetadata("question", MARK).withMetadata("context", MARK), by_page.withMetadata("text", MARK)


def refused(questions: DataFrame, documents: DataFrame, validation: Column) -> DataFrame:
    """query_id, reason, answer of the questions that can't be asked.

    ``questions(query_id, scope, ...)``, scope null for all documents;
    ``documents(document_id)``; ``validation`` is null or what is wrong with the question."""
    known = documents.select(F.col("document_id").alias("scope"), F.lit(True).alias("_known")).distinct()
    none = documents.agg((F.count("*") == 0).alias("_none")).select("_none").scalar()
    unknown = F.col("scope").isNotNull() & F.col("_known").isNull()
    reason = F.when(validation.isNotNull(), validation).when(none, NOTHING_UPLOADED).when(unknown, UNKNOWN_DOCUMENT)
    return questions.join(known, "scope", "left").select("query_id", reason.alias("reason"), F.lit(NO_CONTEXT).alias("answer")).where("reason is not null")


def unanswered(questions: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, reason, answer of the questions without anything found; the reason names a scope only where there is one."""
    left = questions.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return left.select("query_id", F.when(F.col("scope").isNotNull(), NO_MATCH_IN_DOCUMENT).otherwise("").alias("reason"), F.lit(NO_CONTEXT).alias("answer"))


def fallback(first: DataFrame, second: DataFrame, key: str = "query_id") -> DataFrame:
    """``first``, and the rows of ``second`` for the keys that ``first`` has nothing of; adds source (0 or 1)."""
    rest = second.join(first.select(key).distinct(), key, "left_anti")
    return first.withColumn("source", F.lit(0)).unionByName(rest.withColumn("source", F.lit(1)))


def modelled(text: Column, model: Callable[[str], str | None] | None) -> Column:
    """What ``model`` makes of each text: stripped, outer quotes off; null where it fails, gives nothing, or is a simulation."""
    if model is None:
        return F.lit(None).cast("string")

    def one(t: str | None) -> str | None:
        try:
            out = (model(t) or "").strip().strip('"').strip() if t is not None else ""
        except Exception:  # noqa: BLE001  a failing model means: no rewrite
            return None
        return None if not out or out.startswith("[SIMULATED]") else out

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(text)


def rewrite_inputs(questions: DataFrame, messages: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """conv_id, request: what a rewriting or summarising model is given of each question with earlier turns.

    ``questions(conv_id, text)`` and messages must be scrubbed; a conversation without turns gives none."""
    require_scrubbed(questions, "text")
    require_scrubbed(messages, "text")
    said = transcript(turns(messages)).withColumn("transcript", F.concat(F.lit("Recent conversation:\n"), "transcript"))
    rows = questions.select("conv_id", "text").join(said, "conv_id")
    before = F.lit("")
    if summaries is not None:
        rows = rows.join(summaries.select("conv_id", "summary"), "conv_id", "left")
        before = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("Conversation summary:\n"), "summary", F.lit("\n\n"))).otherwise("")
    return rows.select("conv_id", F.concat(before, "transcript", F.lit("\n\nFollow-up question:\n"), "text").alias("request")).withMetadata("request", MARK)


def standalone(rows: DataFrame, question: str, request: str, gate: Column, model: Callable[[str], str | None] | None) -> DataFrame:
    """Adds search_text: the rewritten question where ``gate`` holds and the model gives one, else the question."""
    require_scrubbed(rows, request)
    made = F.when(gate & F.col(request).isNotNull(), modelled(F.col(request), model))
    return rows.withColumn("search_text", F.coalesce(made, question))


def variants(questions: DataFrame, alternatives: Column, most: int = 20) -> DataFrame:
    """query_id, variant, text: the question and its alternatives, repeats by squashed lower case left out, the first ``most``."""
    every = questions.select("query_id", F.posexplode(F.concat(F.array("text"), alternatives)).alias("variant", "text")).where(strip("text") != "")
    key = F.lower(strip(F.regexp_replace("text", r"\s+", " ")))
    first = every.withColumn("_k", key).groupBy("query_id", "_k").agg(F.min(F.struct("variant", "text")).alias("_f")).select("query_id", "_f.*")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("variant"))
    return first.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def materialised(deltas: DataFrame, key: str = "answer_id") -> DataFrame:
    """``key``, text, complete: the answer of each stream of ``deltas(key, seq, delta, is_last)``."""
    held = deltas.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("d")))).alias("x"), F.bool_or("is_last").alias("complete"))
    return held.select(key, F.array_join(F.transform("x", lambda v: v["d"]), "").alias("text"), "complete")
