"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors become one class first.  The classes' second moments give a
rotation that puts the directions of largest spread first.  Unit vectors whose
cosine reaches t lie within sqrt(2 - 2t) of each other in every rotated
dimension, so cells of that width along the leading dimensions leave only
neighbouring cells to compare; the number of leading dimensions follows the
number of vectors.  Cells are cut into blocks, and each pair of blocks of
neighbouring cells is one unit of work.  Inside a unit, rows ordered by the first
dimension are compared in tiles: products of the leading dimensions accumulate,
the rest is bounded by the product of suffix norms, and a tile stops as soon as
no pair can reach the threshold.  What survives is decided in double precision
on the vectors as given.  Units emit link counts and a spanning forest, no pairs.

Nothing is approximate, and no cell or block is capped; a dense cell of
different vectors costs the square of its size in comparisons, which the exact
link counts ask for, but spreads over units.

Edge cases: a vector that is null, empty or zero, or holds null or non-finite
components, links with nothing (0 links, its own component, kept); vectors are
compared with those of their own length only; equal vectors link with each
other; repeated rows are vectors of their own; an empty table gives no rows;
columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import by_unit, units
from .components import components
from .shared import small_batches, table, written


@dataclass(frozen=True)
class Tiles:
    """Parameters of the method."""

    threshold: float = 0.95
    block: int = 8192  # vectors of a block
    tile: int = 512  # rows of a tile
    steps: tuple[int, ...] = (8, 16, 32)  # dimensions after which a tile may stop
    most_axes: int = 6  # leading dimensions with cells
    slack: float = 1e-9  # of the bounds, far above rounding

    @property
    def reach(self) -> float:
        return (2 - 2 * self.threshold) ** 0.5 + 1e-6


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(1))
    return x / norm[:, None], norm


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Orthogonal matrix with the directions of largest spread first; the driver gets d x d sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                u, _ = _unit(_matrix(batch.column(0), d))
                n, total, square = n + len(u), total + u.sum(0), square + u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()]), pa.array([square.ravel().tolist()])], names=["n", "total", "square"])

    many = vectors.select("embedding").mapInArrow(run, "n long, total array<double>, square array<double>")
    # Partial sums of a few hundred tasks at a time are added up on the executors.
    dealt = many.repartition(8, F.spark_partition_id()).mapInArrow(_added, many.schema).toPandas()
    n = max(int(dealt["n"].sum()), 1)
    mean = sum(np.array(x) for x in dealt["total"]) / n
    spread = sum(np.array(x) for x in dealt["square"]).reshape(d, d) / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh(spread)
    return axes[:, np.argsort(-values, kind="stable")]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, square = 0, None, None
    for batch in batches:
        for row in batch.to_pylist():
            t, s = np.array(row["total"]), np.array(row["square"])
            n, total, square = n + row["n"], t if total is None else total + t, s if square is None else square + s
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()]), pa.array([square.tolist()])], names=["n", "total", "square"])


def _cells(nodes: DataFrame, axes: np.ndarray, p: Tiles) -> DataFrame:
    """Adds cell (leading rotated coordinates over the reach, rounded down) to node, mult, embedding."""
    d = len(axes)
    lead = axes[:, : p.most_axes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, _ = _unit(_matrix(batch.column(2), d))
                cell = np.floor(u @ lead / p.reach).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32) * cell.shape[1]), pa.array(cell.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["node", "mult", "embedding", "cell"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    return nodes.select("node", "mult", "embedding").mapInArrow(run, f"node long, mult long, embedding {kind}, cell array<int>")


def _dealt(placed: DataFrame, p: Tiles) -> DataFrame:
    """Vectors dealt to units: pairs of blocks of neighbouring cells."""
    most = len(placed.select("cell").first()["cell"]) if not placed.isEmpty() else 1
    prefix = [F.countDistinct(F.slice("cell", 1, m)).alias(f"c{m}") for m in range(1, most + 1)]
    found = placed.agg(F.count("*").alias("n"), *prefix).first()
    axes = max([1, *(m for m in range(1, most + 1) if found[f"c{m}"] <= 2 * found["n"] / p.block)])
    v = placed.withColumn("cell", F.slice("cell", 1, axes))
    sizes = v.groupBy("cell").agg(F.count("*").alias("_n"))
    v = v.join(sizes, "cell").withColumn("_blk", F.expr(f"pmod(xxhash64(node, 17), _n div {p.block} + 1)")).drop("_n")
    blocks = sizes.select("cell", F.explode(F.expr(f"sequence(0L, _n div {p.block})")).alias("_blk"))
    # Every pair of neighbouring cells once: the offset's first non-zero entry is positive.
    offsets = [o for o in product((-1, 0, 1), repeat=axes) if o >= (0,) * axes]
    steps = F.explode(F.array(*[F.array(*map(F.lit, o)) for o in offsets])).alias("_step")
    a = blocks.select("cell", F.col("_blk").alias("_ba"), steps)
    a = a.select(F.col("cell").alias("_ca"), "_ba", F.zip_with("cell", "_step", lambda x, y: x + y).alias("_cb"))
    pairs = a.join(blocks.select(F.col("cell").alias("_cb"), F.col("_blk").alias("_bb")), "_cb").where("_ca <> _cb or _ba <= _bb")
    pairs = pairs.withColumn("unit", F.xxhash64("_ca", "_ba", "_cb", "_bb"))
    # A block with itself has side -1: where one of two blocks is empty, the other isn't compared within again.
    within = (F.col("_ca") == F.col("_cb")) & (F.col("_ba") == F.col("_bb"))
    sides = pairs.select(F.col("_ca").alias("cell"), F.col("_ba").alias("_blk"), "unit", F.when(within, -1).otherwise(0).alias("side")).union(
        pairs.where(~within).select("_cb", "_bb", "unit", F.lit(1))
    )
    return v.join(sides, ["cell", "_blk"]).select("unit", "side", "node", "mult", "embedding")


def _far(a: np.ndarray, b: np.ndarray, p: Tiles) -> bool:
    """True if no point of one tile's box is within reach of the other's."""
    k = min(p.steps[0], a.shape[1])
    gap = np.maximum(0, np.maximum(a[:, :k].min(0) - b[:, :k].max(0), b[:, :k].min(0) - a[:, :k].max(0)))
    return float(gap @ gap) > 2 - 2 * p.threshold + p.slack


def linked(x: np.ndarray, y: np.ndarray, a: slice, b: slice, norm: np.ndarray, suffix: dict[int, np.ndarray], p: Tiles) -> np.ndarray | None:
    """Which pairs of two tiles reach the threshold; None if none does.

    ``x`` are the vectors as given, ``y`` the rotated unit vectors."""
    if _far(y[a], y[b], p):
        return None
    sums, at = np.zeros((a.stop - a.start, b.stop - b.start)), 0
    left = sums.size  # short vectors have no step to stop at
    for k in sorted(suffix):
        sums += y[a, at:k] @ y[b, at:k].T
        at = k
        alive = sums + np.outer(suffix[k][a], suffix[k][b]) >= p.threshold - p.slack
        left = int(alive.sum())
        if not left:
            return None
        if left * 20 < alive.size:
            break
    else:
        alive = np.ones_like(sums, bool)
    if left * 20 < alive.size:
        i, j = np.nonzero(alive)
        cosine = np.einsum("ij,ij->i", x[a][i], x[b][j]) / (norm[a][i] * norm[b][j])
        alive[i, j] = cosine >= p.threshold
    else:
        alive &= (x[a] @ x[b].T) / np.outer(norm[a], norm[b]) >= p.threshold
    return alive if alive.any() else None


def _labels(ok: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least node of the component of each row and column in the tile's links."""
    big = np.iinfo(np.int64).max
    while True:
        new_right = np.minimum(right, np.where(ok, left[:, None], big).min(0))
        new_left = np.minimum(left, np.where(ok, new_right[None, :], big).min(1))
        if (new_right == right).all() and (new_left == left).all():
            return left, right
        left, right = new_left, new_right


def compare(dealt: DataFrame, axes: np.ndarray, p: Tiles) -> DataFrame:
    """kind 0: forest of links (src, dst); kind 1: src and its number of linked vectors in other classes."""
    d = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(batches):
            x = _matrix(t.column("embedding").combine_chunks(), d)
            node, mult, side = (t.column(c).to_numpy() for c in ("node", "mult", "side"))
            u, _ = _unit(x)
            y = u @ axes
            order = np.lexsort((y[:, 0], side))
            x, y, node, mult, side = x[order], y[order], node[order], mult[order], side[order]
            norm = np.sqrt((x * x).sum(1))
            tail = np.sqrt(np.maximum(np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1], 0))
            suffix = {k: tail[:, k] for k in p.steps if k < d}
            cut = int(np.searchsorted(side, 1))
            tiles = lambda lo, hi: [slice(i, min(i + p.tile, hi)) for i in range(lo, hi, p.tile)]
            lefts, rights = tiles(0, cut), tiles(cut, len(x))
            if side[0] == -1:
                pairs = [(a, b) for i, a in enumerate(lefts) for b in lefts[i:]]
            else:
                pairs = [(a, b) for a in lefts for b in rights]
            links, rows = np.zeros(len(x), np.int64), []
            for a, b in pairs:
                ok = linked(x, y, a, b, norm, suffix, p)
                if ok is None:
                    continue
                if a == b:
                    np.fill_diagonal(ok, False)
                    links[a] += ok @ mult[a]
                else:
                    links[a] += ok @ mult[b]
                    links[b] += ok.T @ mult[a]
                i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
                if not len(i):
                    continue
                na, nb = node[a][i], node[b][j]
                for own, low in zip((na, nb), _labels(ok[np.ix_(i, j)], na, nb), strict=True):
                    moved = own != low
                    rows.append(np.stack([np.zeros(int(moved.sum()), np.int64), own[moved], low[moved]]))
            some = np.flatnonzero(links)
            rows.append(np.stack([np.ones(len(some), np.int64), node[some], links[some]]))
            out = np.concatenate(rows, 1)
            if out.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["kind", "src", "dst"])

    return by_unit(dealt).mapInArrow(run, "kind long, src long, dst long")


def near_vectors(embeddings: DataFrame, p: Tiles = Tiles()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    small_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("length", F.when(usable(F.col("embedding")), F.size("embedding")))
    rows = rows.withColumn("_a", F.xxhash64("embedding")).withColumn("_b", F.xxhash64(F.lit(1), "embedding"))
    rows = written(rows, "vectors")
    classes = rows.where("length is not null").groupBy("length", "_a", "_b").agg(F.min("rid").alias("node"), F.min("vec_id").alias("least_id"), F.count("*").alias("mult"))
    classes = written(classes, "vector-classes")
    nodes = classes.select("node", "mult", "length").join(rows.select(F.col("rid").alias("node"), "embedding"), "node")
    found = []
    for (d,) in classes.select("length").distinct().orderBy("length").collect():  # as many as there are vector lengths
        own = nodes.where(F.col("length") == d)
        axes = rotation(own, d)
        found.append(compare(_dealt(written(_cells(own, axes, p), "cells"), p), axes, p))
    if found:
        out = written(reduce(DataFrame.union, found), "vector-links")
    else:
        out = embeddings.sparkSession.createDataFrame([], "kind long, src long, dst long")
    links = out.where("kind = 1").groupBy(F.col("src").alias("node")).agg(F.sum("dst").alias("links"))
    comps = components(out.where("kind = 0").select("src", "dst"))
    placed = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).join(links, "node", "left")
    least = placed.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    placed = placed.join(least, "comp").select("length", "_a", "_b", "component_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    done = rows.drop("embedding").join(placed, ["length", "_a", "_b"], "left")
    component = F.coalesce("component_id", "vec_id")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_ids AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least_ids l ON l.x = vec_id LEFT JOIN counts c ON c.x = vec_id
"""
