"""Rows of sheets and tables as readable lines and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import strip

SEPARATOR_CELL = r"^[\s|:\-=_+]*-[\s|:\-=_+]*$"


def record(header: Column, row: Column) -> Column:
    """"Name: value | ..." of the cells with both; a short row is padded."""
    pairs = F.zip_with(header, row, lambda h, v: F.when((F.coalesce(h, F.lit("")) != "") & (F.coalesce(v, F.lit("")) != ""), F.concat(h, F.lit(": "), v)))
    return F.array_join(F.filter(pairs, lambda x: x.isNotNull()), " | ")


def _clean(row: Column) -> Column:
    return F.transform(row, lambda c: strip(F.coalesce(c, F.lit(""))))


def render(tables: DataFrame, table: str, order: str, cells: str) -> DataFrame:
    """table, lines: rows of ``cells`` (array<string>) in order, the first as header.

    Empty rows and rows of dashes go; a table with nothing but a header keeps its cells."""
    rows = tables.select(F.col(table).alias("table"), F.col(order).alias("_o"), _clean(F.col(cells)).alias("c"))
    full = F.exists("c", lambda x: x != "") & ~F.forall(F.filter("c", lambda x: x != ""), lambda x: x.rlike(SEPARATOR_CELL))
    held = rows.where(full).groupBy("table").agg(F.array_sort(F.collect_list(F.struct("_o", "c"))).alias("r"))
    every = F.transform("r", lambda x: x["c"])
    lines = F.filter(F.transform(F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0))), lambda c: record(F.element_at(every, 1), c)), lambda x: x != "")
    bare = F.transform(every, lambda c: F.array_join(F.filter(c, lambda x: x != ""), " | "))
    return held.select("table", F.when(F.size(lines) > 0, lines).otherwise(bare).alias("lines"))


def pages(rows: DataFrame, number: str, line: str, per_page: int = 50, most: int | None = None) -> DataFrame:
    """page_number (from 1), content: numbered rows (from 1) as pages of ``per_page`` lines, ``most`` rows where that is given."""
    page = F.floor((F.col(number) - 1) / per_page) + 1
    kept = (rows if most is None else rows.where(F.col(number) <= most)).select(page.alias("page_number"), F.struct(F.col(number).alias("n"), F.col(line).alias("l")).alias("x"))
    return kept.groupBy("page_number").agg(F.array_sort(F.collect_list("x")).alias("x")).select("page_number", F.array_join(F.transform("x", lambda v: v["l"]), "\n").alias("content"))


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, value) with the value of a merged range's first cell over the whole range.

    ``ranges`` has sheet, top, left, bottom, right; ranges are opened into cells, so the join has equal keys."""
    opened = ranges.select("sheet", "top", "left", F.explode(F.sequence("top", "bottom")).alias("row"), "right").select(
        "sheet", "top", "left", "row", F.explode(F.sequence("left", "right")).alias("col")
    )
    corner = cells.select("sheet", F.col("row").alias("top"), F.col("col").alias("left"), F.col("value").alias("_fill"))
    filled = opened.join(corner, ["sheet", "top", "left"], "left").select("sheet", "row", "col", "_fill")
    out = cells.join(filled, ["sheet", "row", "col"], "full_outer")
    return out.select("sheet", "row", "col", F.coalesce(F.nullif("value", F.lit("")), "_fill").alias("value"))
