"""Intermediate tables in the folder that the cluster names for checkpoints."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is named and all runs in one process (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written and read back: cuts the lineage of loops, and survives lost executors."""
    path = f"{folder(df.sparkSession)}/foliant/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str, *more: str) -> str:
    """A name for the state of the files of a table at ``path``, in all its folders: their names, lengths and times.

    Spark lists them, many folders on the executors; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    state = files.select(F.xxhash64("path", "length", "modificationTime").alias("a"), F.xxhash64("modificationTime", "length", "path").alias("b"), "length")
    found = state.agg(F.count("*"), F.sum("length"), F.bit_xor("a"), F.bit_xor("b")).first()
    return hashlib.sha256(repr((path, *found, more)).encode()).hexdigest()[:32]


def once(spark: SparkSession, path: str, make: Callable[[str], None]) -> None:
    """Have ``make`` write ``path`` if it isn't there: beside it first, then moved, so that no reader sees a part."""
    at, system = _files(spark, path)
    if system.exists(at):
        return
    beside = f"{path}-{uuid.uuid4().hex}"
    make(beside)
    made, _ = _files(spark, beside)
    if system.exists(at) or not system.rename(made, at):  # another one was faster
        system.delete(made, True)
