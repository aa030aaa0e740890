"""Choosing among extractions of one page: engines in order of cost, the first that is good enough.

Readers of PDF pages and images come from outside; each gives a column of text.
What they share is here: which text to take, which engine gave it, and which
pages of a long file are read at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import is_gibberish, looks_tabular, strip

LEAST_CHARS = 100
MOST_PAGES = 100


def is_good(text: Column, least: int = LEAST_CHARS) -> Column:
    """Enough text that is not noise."""
    return F.coalesce((F.length(text) >= least) & ~is_gibberish(text), F.lit(False))


def cascade(engines: dict[str, tuple[Column, Column]], last: str) -> Column:
    """struct<engine, text> of the first engine whose (text, verdict) holds, else of ``last``, or of none where that one is blank."""
    pick = lambda name: F.struct(F.lit(name).alias("engine"), engines[name][0].alias("text"))
    out = None
    for name, (_, good) in engines.items():
        if name != last:
            out = F.when(good, pick(name)) if out is None else out.when(good, pick(name))
    blank = F.coalesce(strip(engines[last][0]), F.lit("")) == ""
    empty = F.struct(F.lit("none").alias("engine"), F.lit("").alias("text"))
    return F.when(blank, empty).otherwise(pick(last)) if out is None else out.when(~blank, pick(last)).otherwise(empty)


def first_text(*texts: Column) -> Column:
    """The first text that is not blank: recognition engines in order."""
    return F.coalesce(*(F.nullif(strip(t), F.lit("")) for t in texts), F.lit(""))


def page_texts(pages: DataFrame, plain: str, layout: str, tables: str, recognised: str, most_pages: int = MOST_PAGES) -> DataFrame:
    """document_id, page_number, engine, text of ``pages`` with one column per engine, the first ``most_pages`` of a file.

    A tabular page prefers its tables where there are any; a page without good text is recognised."""
    t, y, b, o = (F.col(c) for c in (plain, layout, tables, recognised))
    tabular = looks_tabular(plain) & (F.coalesce(strip(b), F.lit("")) != "")
    chosen = cascade({"tables": (b, tabular), "text": (t, is_good(t)), "layout": (y, is_good(y)), "ocr": (o, F.lit(True))}, "ocr")
    kept = pages.where(F.col("page_number") <= most_pages)
    return kept.withColumn("_c", chosen).select("document_id", "page_number", "_c.engine", "_c.text")


def pages_left_out(pages: DataFrame, most_pages: int = MOST_PAGES) -> DataFrame:
    """document_id, left_out: pages beyond the cap, of the files that have any."""
    return pages.where(F.col("page_number") > most_pages).groupBy("document_id").agg(F.count("*").alias("left_out"))
