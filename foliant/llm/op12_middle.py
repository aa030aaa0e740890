"""Fill-in-middle transformation in SQL of DuckDB over Arrow batches.

A text is cut at two places that a hash of its id chooses, and its parts are
written behind marks: prefix, suffix, middle, or suffix first.  Each task has
one in-process DuckDB; the batches of ``mapInArrow`` are registered there in
slices of bounded bytes and answered by one statement, so no row passes through
Python.  The statement takes a text apart with ``regexp_extract_all`` into runs
of ``RUN`` code points, so a long text's list is short, and only the run that
a cut falls into is taken apart into code points; ``list_slice`` and
``array_to_string`` put the parts together.  Hashes are ``sha256`` of the seed
and the id: the result depends on the row alone, not on partitions or retries.

``restored`` gives the text back from an output and its form.

Edge cases: a null or empty text is plain, n 0, output empty; a text that
already has a mark is plain; a null id is hashed as an empty one; equal rows
have equal results; a text of one code point is cut before or behind it; a kept
column with the name of a result column gives way to it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table

#: The marks.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULT = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


@dataclass(frozen=True)
class Middle:
    """Parameters of the method."""

    seed: int = 1
    cut_percent: int = 90  # of the texts that can be cut
    suffix_first_percent: int = 20  # of those that are cut
    run: int = 64  # code points of a run; the fastest of 1, 50, 64, 250
    slice_bytes: int = 4 << 20  # of texts that DuckDB sees at a time; a longer text is alone


def statement(p: Middle) -> str:
    """The transformation of the registered table ``slice(i, id, text)``."""
    part = lambda a, b: f"list_slice(runs, {a} // {p.run} + 2, {b} // {p.run})"  # noqa: E731  whole runs between two cuts
    units = lambda at: f"regexp_extract_all(coalesce(list_extract(runs, {at} // {p.run} + 1), ''), '(?s).')"  # noqa: E731  of the run that a cut falls into
    join = lambda x: f"array_to_string({x}, '')"
    return f"""
WITH hashed AS (
  SELECT i, coalesce(text, '') AS text, sha256('{p.seed}:' || coalesce(id, '')) AS h FROM slice),
taken AS (
  SELECT i, text, regexp_extract_all(text, '(?s).{{1,{p.run}}}') AS runs,
    {", ".join(f"('0x' || substring(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))}
  FROM hashed),
counted AS (
  SELECT *, CASE WHEN text = '' THEN 0 ELSE (len(runs) - 1) * {p.run} + length(runs[-1]) END AS n,
    text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {p.cut_percent} AS plain
  FROM taken),
placed AS (
  SELECT i, text, runs, n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < {p.suffix_first_percent} THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM counted),
opened AS (
  SELECT *, CASE WHEN form <> 'plain' THEN {units("a")} END AS ua, CASE WHEN form <> 'plain' THEN {units("b")} END AS ub FROM placed),
cut AS (
  SELECT i, n, form, text, a, b,
    {join(f"list_slice(runs, 1, a // {p.run})")} || {join(f"list_slice(ua, 1, a % {p.run})")} AS prefix,
    CASE WHEN a // {p.run} = b // {p.run} THEN {join(f"list_slice(ua, a % {p.run} + 1, b % {p.run})")}
      ELSE {join(f"list_slice(ua, a % {p.run} + 1, {p.run})")} || {join(part("a", "b"))} || {join(f"list_slice(ub, 1, b % {p.run})")} END AS middle,
    {join(f"list_slice(ub, b % {p.run} + 1, {p.run})")} || {join(f"list_slice(runs, b // {p.run} + 2, len(runs))")} AS suffix
  FROM opened)
SELECT n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
FROM cut ORDER BY i"""


def _slices(text: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text."""
    lengths = [x or 0 for x in pc.binary_length(text).to_pylist()]
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def _engine() -> duckdb.DuckDBPyConnection:
    """A DuckDB of this task: one thread, in memory, no files."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": "", "python_enable_replacements": False})


def fill_in_middle(documents: DataFrame, p: Middle = Middle(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n, form, prefix_chars, middle_chars and output of every document."""
    small_batches(documents.sparkSession)
    keep = tuple(c for c in keep if c not in RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _engine() as engine:
            sql = statement(p)
            for batch in batches:
                for a, b in _slices(batch.column(1), p.slice_bytes):
                    some = batch.slice(a, b - a)
                    engine.register("slice", pa.table({"i": pa.array(range(b - a), pa.int64()), "id": some.column(0), "text": some.column(1)}))
                    found = engine.sql(sql).to_arrow_table().combine_chunks()
                    engine.unregister("slice")
                    columns = [found.column(name).chunk(0) for name in RESULT]
                    yield pa.RecordBatch.from_arrays([*some.columns[2:], *columns], names=[*keep, *RESULT])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema), *(f"{k} {v}" for k, v in RESULT.items())])
    return documents.select(F.col("doc_id").cast("string").alias("_id"), F.col("text").alias("_text"), *keep).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that was cut: what stands between the marks, in the order of the text.

    A text that is cut has no mark, so the first one of a kind is the one that was set."""

    def between(order: tuple[str, str, str]) -> Column:
        first = F.substring_index(F.substring(output, F.lit(len(order[0]) + 1), F.length(output)), order[1], 1)
        rest = F.substring(output, F.length(first) + len(order[0]) + len(order[1]) + 1, F.length(output))
        second = F.substring_index(rest, order[2], 1)
        third = F.substring(rest, F.length(second) + len(order[2]) + 1, F.length(rest))
        parts = dict(zip(order, (first, second, third), strict=True))
        return F.concat(parts[PREFIX], parts[MIDDLE], parts[SUFFIX])

    return F.when(form == "psm", between((PREFIX, SUFFIX, MIDDLE))).when(form == "spm", between((SUFFIX, PREFIX, MIDDLE))).otherwise(output)


def digest(cut: DataFrame) -> DataFrame:
    hashed = cut.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)})
    return hashed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_duckdb_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL = f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
g AS (SELECT *, {", ".join(f"('0x' || substring(x, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))} FROM h),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
  ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END AS out FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(out) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
