"""Named tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Arrow settings of texts that Python cuts into many pieces: Spark's defaults, and what holds in their place.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(64 << 20), str(8 << 20))}


def small_batches(spark: SparkSession) -> None:
    """Batches of a bounded size for Python, where the session has Spark's defaults: a worker's memory is that of a batch, whatever the table."""
    for key, (default, mine) in ARROW.items():
        if spark.conf.get(key, default) in (default, f"{default}b"):
            spark.conf.set(key, mine)


#: Bytes of a table for each core, up to which it is spread.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as cores, if it is a small table of few row groups that would keep most cores idle.

    Small is less than ``SPREAD_BYTES`` a core: a larger table is never shuffled for this, however many the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{directory}/{name}.parquet"))
