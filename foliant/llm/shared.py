"""Helpers shared by the operators: table access, hash splits, written intermediates."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Column of the row numbers that ``numbered`` gives.
RID = "__foliant_rid"


#: Bytes of a table for each core, up to which it is spread.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as cores, if it is a small table of few row groups that would keep most cores idle.

    Small is less than ``SPREAD_BYTES`` a core: a larger table is never shuffled for this, however many the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named and all runs in one process (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="foliant-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_RECORDS: list[list[DataFrame]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables that ``written`` writes inside, for ``discard`` later."""
    _RECORDS.append([])
    try:
        yield _RECORDS[-1]
    finally:
        _RECORDS.pop()


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back.

    It cuts the lineage: whatever is lost later is read again from the shared
    store, and an expensive input is not computed once per use."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/foliant/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliant_folder = path
    for record in _RECORDS:
        record.append(out)
    return out


def settled(make: Callable[[], DataFrame], what: str) -> DataFrame:
    """What ``make`` gives, written; the tables that it wrote on the way go."""
    with recorded() as tables:
        out = written(make(), what)
    discard(*(t for t in tables if t is not out))
    return out


def numbered(df: DataFrame, what: str, **more: Column) -> DataFrame:
    """``df`` written with a number of its own for each row (``RID``) and ``more`` columns.

    Rows meet what is found out about them by this number, equal rows too."""
    return written(df.withColumns(more | {RID: F.monotonically_increasing_id()}), what)


def reads(df: DataFrame, folder: str) -> bool:
    """Whether ``df`` scans files under ``folder``; True where that can't be told."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    name = folder.rstrip("/").rpartition("/")[2]
    for i in range(leaves.size()):
        try:
            roots = leaves.apply(i).relation().location().rootPaths()
        except Py4JError:
            return True
        if any(f"/{name}" in f"{roots.apply(j).toString()}/" for j in range(roots.size())):
            return True
    return False


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote, once all that reads it has been written itself."""
    for t in tables:
        folder = getattr(t, "_foliant_folder", None)
        if folder:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def crc_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return (F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFFF)) / F.lit(float(1 << 32))).cast("double")


#: Session settings that keep what passes between Spark and Python small, whatever the texts' length.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(64 << 20), str(8 << 20))}


def small_batches(spark: SparkSession) -> None:
    """Set the Arrow batch limits, where the session still has Spark's defaults."""
    for key, (default, ours) in ARROW.items():
        if str(spark.conf.get(key, default)).rstrip("bB") in (default, "64MB", "64m"):
            spark.conf.set(key, ours)
