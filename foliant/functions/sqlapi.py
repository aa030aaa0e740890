"""The engine's functions by name in ``spark.sql``, and its tables as views."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from foliant.functions.text import nfkc
from foliant.operators import redact
from foliant.operators.chunk import Chunker
from foliant.sources.tables import table
from foliant.sources.web import main_text


class ChunkText:
    """LATERAL chunk_text(text, size, overlap): n (from 1), chunk."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(Chunker(size, overlap).split(text), 1)


def register(spark: SparkSession, folder: str | None = None, tables: tuple[str, ...] = ()) -> None:
    """Functions nfkc, main_text, pii_spans, pii_redact and the table function chunk_text; ``tables`` of ``folder`` as views."""
    spark.udf.register("nfkc", nfkc)
    spark.udf.register("main_text", main_text)
    spark.udf.register("pii_spans", redact.spans_udf)
    spark.udf.register("pii_redact", redact.scrub_udf)
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="n int, chunk string"))
    for name in tables:
        table(spark, folder, name).createOrReplaceTempView(name)
