"""Chunk store and conversation log on plain Parquet.

A tenant is a partition value that every call takes, and a document is a
partition below it: reading one tenant or document prunes the rest, and
replacing a document overwrites its partition alone.  Conversations are an
append-only log of events; the current state is a fold of it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tenant_of(user_id: str) -> str:
    """Partition value of a user: letters, digits, dashes and underscores as they are, anything else by digest."""
    plain = user_id.replace("-", "").replace("_", "")
    return user_id if plain.isalnum() and plain.isascii() else "u" + hashlib.sha256(user_id.encode()).hexdigest()[:24]


class ChunkStore:
    """Chunks (document_id, chunk_id, ...) of all tenants under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, tenant: str, chunks: DataFrame, mode: str) -> None:
        rows = chunks.withColumn("tenant", F.lit(tenant_of(tenant)))
        writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("mergeSchema", "true")
        writer.partitionBy("tenant", "document_id").parquet(self.path)

    def add(self, tenant: str, chunks: DataFrame) -> None:
        self._write(tenant, chunks, "append")

    def replace(self, tenant: str, chunks: DataFrame) -> None:
        """The documents of ``chunks`` become these chunks; others stay.  ``chunks`` must not read this store."""
        self._write(tenant, chunks, "overwrite")

    def read(self, tenant: str, document_id: str | None = None) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", "true").option("basePath", self.path).parquet(self.path).where(F.col("tenant") == tenant_of(tenant))
        return rows if document_id is None else rows.where(F.col("document_id") == document_id)

    def documents(self, tenant: str) -> DataFrame:
        """document_id and number of chunks."""
        return self.read(tenant).groupBy("document_id").agg(F.count("*").alias("chunks"))

    def delete(self, tenant: str, document_id: str | None = None) -> bool:
        """Drop a document's partition, or a tenant's; true if there was one."""
        part = f"{self.path}/tenant={tenant_of(tenant)}" + ("" if document_id is None else f"/document_id={_escaped(self.spark, document_id)}")
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(part)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _escaped(spark: SparkSession, value: str) -> str:
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def fold_conversations(log: DataFrame) -> DataFrame:
    """State of every conversation that is not deleted: title, document, summary, messages, updated_at.

    ``log`` has seq, at, conv_id, kind (create, rename, attach, summary, message, delete) and value;
    for each field the last event of its kind counts."""
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, F.col("seq")))
    rename = F.max_by(F.when(F.col("kind").isin("create", "rename"), F.col("value")), F.when(F.col("kind").isin("create", "rename"), F.col("seq")))
    state = log.groupBy("conv_id").agg(
        rename.alias("title"), last("attach").alias("document_id"), last("summary").alias("summary"), F.count_if(F.col("kind") == "message").alias("messages"),
        F.max("at").alias("updated_at"), F.count_if(F.col("kind") == "delete").alias("_gone"),
    )
    return state.where("_gone = 0").drop("_gone")


def checked_feedback(log: DataFrame) -> DataFrame:
    """message_id, feedback: the last mark of each message (up, down, or cleared); any other mark fails the job."""
    mark = F.when(F.col("mark").isNull() | F.col("mark").isin("up", "down"), F.col("mark")).otherwise(F.raise_error(F.concat(F.lit("bad feedback: "), "mark")).cast("string"))
    return log.select("message_id", "seq", mark.alias("mark")).groupBy("message_id").agg(F.max(F.struct("seq", "mark")).alias("x")).select("message_id", F.col("x.mark").alias("feedback"))
