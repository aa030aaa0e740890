"""A saved index of vectors in cells, with exact nearest neighbours by angular bounds.

Centres are trained on a bounded sample; every vector is indexed, in the cell of
its closest centre and there in a ring by its angle to the centre.  For a query at
angle t to a centre, no vector of a ring between the angles a and b is closer than
max(t - b, a - t, 0); so a ring whose best possible cosine lies below the k-th
score found so far is never read.  Rings that can't be left out are scored in
full, so the result is that of :func:`foliant.operators.dense.nearest`.

Edge cases: a null vector, or one with null or non-finite components, is not in
the index and asks for nothing; a zero vector has cosine 0 to all; repeated rows
stay repeated; an empty table or set of queries gives no rows; other columns are
left out.  All vectors must have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import dense
from foliant.operators.bm25 import top_k
from foliant.sources.scratch import once, version, written

#: Vectors that the centres are trained on, at most; all are indexed.
SAMPLE = 65_536
#: Centres at most; below that the square root of the number of vectors.
CELLS = 4096
#: Rings of a cell, of equal angles.
RINGS = 32
#: Vectors of a ring that one task holds; a larger ring is dealt to several.
UNIT = 32_768
#: Scores are rounded to six digits: a bound must be lower by so much to leave a ring out.
SLACK = 1e-6
#: Beyond this part of all query-vector pairs the bounds save nothing, and blocks meet blocks.
WORTH = 0.5

_PAIRS = "query_id long, vector array<double>, cell int, ring int"


def sound(vectors: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and vector, in double precision, of vectors whose components are all finite numbers."""
    v = F.col("vector").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.select(*(F.col(c).cast("long") for c in keep), v.alias("vector")).where((F.size("vector") > 0) & F.forall("vector", finite))


def trained(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of unit vectors: the same for the same sample in the same order."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy() if len(sample) else sample
    for _ in range(rounds if len(sample) else 0):
        home = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(sample), 4096)])
        order = np.argsort(home, kind="stable")
        held, start = np.unique(home[order], return_index=True)
        centres[held] = dense._unit(np.add.reduceat(sample[order], start, axis=0))
    return centres


def build(vectors: DataFrame, path: str, sample: int = SAMPLE, cells: int = CELLS) -> CellIndex:
    """Index ``vectors(doc_id, vector)`` at ``path``.  Centres come from at most ``sample`` vectors, the first by hash."""
    spark, all_of_them = vectors.sparkSession, sound(vectors, "doc_id")
    n = all_of_them.count()
    share = F.pmod(F.xxhash64("doc_id", "vector"), F.lit(1 << 30))
    some = all_of_them.where(F.exists("vector", lambda x: x != 0)).where(share <= F.lit(int(min(1.0, 2 * sample / max(n, 1)) * (1 << 30))))
    picked = some.orderBy(share, "doc_id", "vector").limit(sample).select("vector").toArrow().column(0).combine_chunks()
    centres = trained(dense._unit(dense._stacked(picked)), max(1, min(cells, round(n**0.5)))) if len(picked) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _placed(batch, shared.value)

    placed = all_of_them.mapInArrow(place, "doc_id long, vector array<double>, cell int, ring int, angle double")
    placed = placed.withColumn("deal", F.monotonically_increasing_id())
    # Copies of one vector may fill a ring: the range is cut by their numbers too.
    placed.repartitionByRange("cell", "ring", "deal").sortWithinPartitions("cell", "ring").write.parquet(f"{path}/vectors")
    held = spark.read.parquet(f"{path}/vectors")
    rings = held.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    rings.coalesce(1).write.parquet(f"{path}/rings")  # at most CELLS x RINGS rows
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return CellIndex(spark, path)


def _placed(batch: pa.RecordBatch, centres: np.ndarray) -> pa.RecordBatch:
    """Cell, ring and angle of each vector; zero vectors are in cell -1."""
    x = dense._unit(dense._stacked(batch.column(1)))
    zero = ~x.any(1)
    if len(centres):
        cosine = x @ centres.T
        cell = cosine.argmax(1)
        angle = np.arccos(np.clip(cosine[np.arange(len(x)), cell], -1, 1))
    else:
        cell, angle = np.zeros(len(x), int), np.zeros(len(x))
    ring = np.minimum((angle * (RINGS / np.pi)).astype(np.int32), RINGS - 1)
    cell, ring, angle = np.where(zero, -1, cell), np.where(zero, 0, ring), np.where(zero, 0.0, angle)
    columns = [*batch.columns, pa.array(cell, pa.int32()), pa.array(ring, pa.int32()), pa.array(angle, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "vector", "cell", "ring", "angle"])


def kept(spark: SparkSession, path: str, shared: str, key: str = "vec_id", vector: str = "embedding") -> CellIndex:
    """The index of the table at ``path``, made once for each state of its files, below the folder ``shared``."""
    where = f"{shared}/cells-{version(spark, path, key, vector)}"
    once(spark, where, lambda to: build(spark.read.parquet(path).select(F.col(key).alias("doc_id"), F.col(vector).alias("vector")), to))
    return CellIndex(spark, where)


@dataclass(frozen=True)
class _Map:
    """What a task knows of the index: its centres, and the place, size and angles of every ring."""

    centres: np.ndarray
    cell: np.ndarray
    ring: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The best cosine that a vector of each ring can have, per query (a row each); 0 for zero queries and vectors."""
        if not len(self.centres):
            return np.zeros((len(queries), len(self.cell)))
        t = np.arccos(np.clip(queries @ self.centres.T, -1, 1))[:, np.maximum(self.cell, 0)]
        best = np.cos(np.maximum(np.maximum(t - self.high, self.low - t), 0))
        best[:, self.cell < 0] = 0
        best[~queries.any(1)] = 0
        return best


class CellIndex:
    """The index at ``path``: its map, at most CELLS x RINGS rows and CELLS centres, goes to every task."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rings = spark.read.parquet(f"{path}/rings")
        rings = self.rings.orderBy("cell", "ring").toArrow()  # at most CELLS x RINGS rows
        centres = spark.read.parquet(f"{path}/centres").orderBy("cell").select("centre").toArrow().column(0).combine_chunks()
        stacked = dense._stacked(centres) if len(centres) else np.zeros((0, 1))
        self.map = _Map(stacked, *(rings.column(c).to_numpy() for c in ("cell", "ring", "n", "low", "high")))
        self.shared = spark.sparkContext.broadcast(self.map)

    def probed(self, queries: DataFrame, rows: int, probes: int) -> DataFrame:
        """Of each query the rings with the best bounds, at least ``probes`` of them and until they hold ``rows`` vectors."""
        shared = self.shared

        def chosen(best: np.ndarray, _: pa.RecordBatch) -> np.ndarray:
            order = np.argsort(-best, axis=1, kind="stable")
            before = np.cumsum(shared.value.n[order], 1) - shared.value.n[order]
            take = (before < rows) | (np.arange(best.shape[1]) < probes)
            out = np.zeros(best.shape, bool)
            np.put_along_axis(out, order, take, 1)
            return out

        return self._chosen(queries, chosen)

    def needed(self, queries: DataFrame) -> DataFrame:
        """Of each query, with the k-th score found as ``least`` (null: fewer found), the rings whose bound reaches it."""

        def chosen(best: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            least = batch.column("least").to_numpy(zero_copy_only=False)
            return best + SLACK >= np.where(np.isnan(least), -np.inf, least)[:, None]

        return self._chosen(queries, chosen)

    def _chosen(self, queries: DataFrame, chosen) -> DataFrame:
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 64):  # bounds of 64 queries are at hand at a time
                    batch = whole.slice(at, 64)
                    best = shared.value.bounds(dense._unit(dense._stacked(batch.column("vector"))))
                    i, j = np.nonzero(chosen(best, batch))
                    for cut in range(0, len(i), 8192):
                        a, b = pa.array(i[cut : cut + 8192]), j[cut : cut + 8192]
                        cells = [pa.array(shared.value.cell[b], pa.int32()), pa.array(shared.value.ring[b], pa.int32())]
                        yield pa.RecordBatch.from_arrays([batch.column("query_id").take(a), batch.column("vector").take(a), *cells], ["query_id", "vector", "cell", "ring"])

        return queries.mapInArrow(run, _PAIRS)

    def scored(self, pairs: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
        """The k best of every unit of a ring for the queries that ask for it: query_id, doc_id, score.

        Units and blocks of queries have a bounded size: a large ring is dealt to several tasks, and so are the queries of one that many ask for."""
        asked = pairs.groupBy("cell", "ring").agg(F.count("*").alias("asked"))
        sizes = self.rings.join(asked, ["cell", "ring"]).select(
            "cell", "ring", F.ceil(F.col("n") / UNIT).alias("_parts"), F.ceil(F.col("asked") / dense.QUERY_BLOCK).alias("_blocks")
        )
        sizes = F.broadcast(sizes)  # at most CELLS x RINGS rows
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = pairs.join(sizes, ["cell", "ring"]).withColumn("_block", F.pmod(F.xxhash64("query_id", "vector"), "_blocks")).withColumn("_part", every("_parts"))
        held = self.spark.read.parquet(f"{self.path}/vectors").select("doc_id", "vector", "cell", "ring", "deal")
        right = held.join(sizes, ["cell", "ring"]).withColumn("_part", F.pmod("deal", "_parts")).withColumn("_block", every("_blocks"))
        rule, key = dense._Rule(k, False, exclude_self), ["cell", "ring", "_part", "_block"]

        def run(asked: pa.Table, held: pa.Table) -> pa.Table:
            if not asked.num_rows or not held.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            best = dense._Best(asked, rule)
            for batch in held.select(["doc_id", "vector"]).to_batches(max_chunksize=1024):
                best.meet(batch)
            return pa.table(best.columns())

        left, right = left.select("query_id", "vector", *key), right.select("doc_id", "vector", *key)
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, dense._FOUND)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 2, exact: bool = True, exclude_self: bool = True) -> DataFrame:
        """query_id, doc_id, score (cosine, 6 digits) and rank of the k nearest vectors of each of ``queries(query_id, vector)``.

        The first pass reads the ``probes`` rings with the best bounds; its k-th score decides what a second pass reads, which makes
        the result exact.  Without ``exact`` the first pass is the result: it may miss neighbours, and ``recall`` tells how many."""
        queries = sound(queries, "query_id")
        first = top_k(self.scored(self.probed(queries, k + 1, probes), k, exclude_self), k)
        if not exact:
            return first
        least = first.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("_n"), F.min("score").alias("least"))
        floors = written(least.select("query_id", F.when(F.col("_n") >= k, F.col("least")).alias("least")), "floors")
        pairs = self.needed(queries.join(floors, "query_id", "left"))
        if self.work(pairs) > WORTH * queries.count() * int(self.map.n.sum()):
            held = self.spark.read.parquet(f"{self.path}/vectors").select("doc_id", "vector")
            return dense.nearest(held, queries, k, exclude_self=exclude_self)
        return top_k(self.scored(pairs, k, exclude_self), k)

    def work(self, pairs: DataFrame) -> int:
        """How many query-vector products ``pairs`` stand for."""
        return pairs.groupBy("cell", "ring").count().join(F.broadcast(self.rings), ["cell", "ring"]).agg(F.coalesce(F.sum(F.col("n") * F.col("count")), F.lit(0))).first()[0]


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The part of ``exact``'s neighbours (query_id, doc_id) that ``found`` has; 1 where there are none."""
    pairs = exact.select("query_id", "doc_id").distinct()
    hits = pairs.join(found.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    return hits.count() / max(pairs.count(), 1) if pairs.limit(1).count() else 1.0
