"""All pairs of two tables' rows that share a key, where a key may have most rows of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources.scratch import written

#: Rows of either side of a key that meet in one group, and about how many pairs a task makes.
BLOCK = 4096
PAIRS = 16_000_000


def paired(rows: DataFrame, listed: DataFrame, keys: list[str], block: int | None = None, listing: int | None = None, number: str = "") -> DataFrame:
    """Every row of ``rows`` with every row of ``listed`` of its keys.  No two rows of ``listed`` are equal; a column
    ``number`` that is there to tell them apart is not returned.

    Pairs are as many as the product of a key's rows, so both sides of a key are cut into
    blocks by hash and each two blocks meet in a group of their own: a key that has most rows
    is spread over all tasks, and no task holds more than a block.  A block of ``listed`` is one
    array (of about ``listing`` rows) that each row steps through: a pair is neither sorted nor looked up.  Spark holds
    the pairs of one row at a time: shorter lists leave less for the collector of garbage, and shuffle ``rows`` more often."""
    block = block or BLOCK
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    met = written(count(rows, "_a").join(count(listed, "_b"), keys), "pair-keys")
    pairs = met.agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0))).first()[0]
    parts = max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS))  # few blocks fall together
    blocks = met.select(*keys, F.ceil(F.col("_a") / block).cast("int").alias("_m"), F.ceil(F.col("_b") / (listing or block)).cast("int").alias("_n"))
    own = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = [*keys, "_i", "_j"]
    left = rows.join(blocks, keys).withColumn("_i", own(rows, "_m")).withColumn("_j", each("_n")).drop("_m", "_n")
    right = listed.join(blocks, keys).withColumn("_j", own(listed, "_n")).withColumn("_i", each("_m")).drop("_m", "_n")
    one = F.struct(*[c for c in listed.columns if c not in (*keys, number)])
    arrays = right.repartition(parts, *both).groupBy(*both).agg(F.collect_list(one).alias("_l"))
    return left.repartition(parts, *both).join(arrays, both).select(*rows.columns, F.inline("_l"))
