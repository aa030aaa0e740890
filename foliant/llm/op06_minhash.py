"""MinHash near-dedup with sequential Bayesian verification.

1. One pass over the texts gives each document's number of distinct 3-word
   shingles, a 128-bit digest of the set and a MinHash signature.  Documents of
   equal sets are one class from here on (partial sums by digest).
2. Signatures are cut into bands; classes that share a band key are candidates.
   Bands carry ids only.
3. Every member of a bucket is tested against the bucket's least member, in
   units of some hundred members: signature batches are compared one after the
   other, and a pair is dropped as soon as the posterior probability of reaching
   the threshold falls below the chosen miss probability; what survives is
   verified exactly on full sets.
4. What is still apart in a bucket is tested the same way in blocks, pair by
   pair but without emitting pairs: units of two blocks give a spanning forest of
   the surviving comparisons.  Its components are families; members of a family
   meet once with their full sets and are verified exactly, again in blocks.
5. Links of both steps give the components.

No group is gathered whole in a task or on the driver, and no bucket is capped.
The chance to miss a pair of similarity s is (1 - s**rows)**bands (1.2e-5 at
0.85 with 24 bands of 6 rows) plus the miss probability per tested batch.
Shingles are compared by 64-bit hashes.

Edge cases: null or empty text, or text without words, is an empty set: linked
with nothing, its component is its own doc_id; with fewer words than a shingle
the whole sequence is the one shingle; rows that repeat an id or have none are
judged by their own texts; a null doc_id stays null, and the least doc_id of a
component is the least of those that are not; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .blocks import BLOCK, block_pairs, by_unit, units
from .components import Forest, components
from .shared import RID, numbered, settled, small_batches, table, written


@dataclass(frozen=True)
class MinHash:
    """Parameters of the method."""

    shingle_words: int = 3
    percent: int = 85  # link when 100 * intersection >= percent * union
    bands: int = 24
    rows: int = 6
    batch: int = 24  # signature positions compared at a time
    miss: float = 1e-6  # a pair is dropped when P(similarity >= threshold) is below this
    seed: int = 1

    @property
    def k(self) -> int:
        return self.bands * self.rows


#: Near-duplicates by five-word shingles at 0.8, for uses without a contract of their own.
GENERAL = MinHash(shingle_words=5, percent=80, bands=32)


def least_matches(p: MinHash) -> list[tuple[int, int]]:
    """(positions compared, fewest matches that keep a pair) for each batch.

    With a uniform prior and m matches of n, P(s >= t) = P(Binomial(n + 1, t) <= m)."""
    t, out = p.percent / 100, []
    for n in range(p.batch, p.k + 1, p.batch):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= p.miss:
                out.append((n, m))
                break
    return out


def shingles(texts: tk.Texts, p: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle) of each document: hashes and document indexes, ascending."""
    low = texts.lowered()
    w = low.words()
    h = low.hashes(w)
    bounds = tk.per_doc(w.doc, texts.n)
    count = np.diff(bounds)
    g, d = tk.grams(h, w.doc, p.shingle_words)
    for few in range(1, p.shingle_words):
        short = count[w.doc] == few
        if short.any():
            g2, d2 = tk.grams(h[short], w.doc[short], few)
            g, d = np.concatenate([g, tk.mix(g2 + tk.U(few))]), np.concatenate([d, d2])
    return tk.distinct(g, d)


def _constants(p: MinHash) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(p.seed)
    return rng.randint(0, 1 << 31, p.k).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.randint(0, 1 << 32, p.k, dtype=np.uint64).astype(np.uint32)


def _signatures(g: np.ndarray, bounds: np.ndarray, p: MinHash) -> np.ndarray:
    """16 bits of each of k MinHashes of the non-empty sets."""
    starts = bounds[:-1][bounds[1:] > bounds[:-1]]
    out = np.zeros((len(starts), p.k), np.uint16)
    if len(starts):
        mult, xor = _constants(p)
        h = (g >> tk.U(32)).astype(np.uint32)
        for j in range(p.k):
            out[:, j] = tk.mix(np.minimum.reduceat((h ^ xor[j]) * mult[j], starts).astype(tk.U)).astype(np.uint16)
    return out


def profile(documents: DataFrame, p: MinHash, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, place (a hash of id and text), ``keep``, n_shingles, digest (null: empty set) and signature of every row."""
    m = 2 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in tk.pieces(batch.column(m)):
                g, d = shingles(texts, p)
                b = tk.per_doc(d, texts.n)
                sig = iter(_signatures(g, b, p))
                digest: list = [None] * texts.n
                signature: list = [None] * texts.n
                for q in range(texts.n):
                    if b[q] < b[q + 1]:
                        digest[q] = xxhash.xxh3_128_digest(g[b[q] : b[q + 1]].tobytes())
                        signature[q] = next(sig).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, texts.n) for c in batch.columns[:m]), pa.array(np.diff(b), pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())],
                    names=["doc_id", "place", *keep, "n_shingles", "digest", "signature"],
                )

    rows = documents.select(F.col("doc_id").cast("long"), _place(), *(F.col(c).cast("long") for c in keep), "text")
    kept = "".join(f"`{c}` long, " for c in keep)
    return rows.mapInArrow(run, f"doc_id long, place long, {kept}n_shingles long, digest binary, signature binary")


def _bands(nodes: DataFrame, p: MinHash) -> DataFrame:
    """node and key, one row per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, p.bands, p.rows).astype(tk.U)
            key = np.zeros(sig.shape[:2], tk.U)
            for r in range(p.rows):
                key = key * tk.U(0x9FB21C651E98DF25) + sig[:, :, r] + tk.U(1)
            key = tk.mix(key + np.arange(p.bands, dtype=tk.U)[None, :] * tk.U(0xD6E8FEB86659FD93))
            node = np.repeat(batch.column(0).to_numpy(), p.bands)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(key.ravel().view(np.int64))], names=["node", "key"])

    return nodes.select("node", "signature").mapInArrow(run, "node long, key long")


def _alive(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of signature rows survive every batch; a and b broadcast against each other."""
    shape = np.broadcast_shapes(a.shape, b.shape)[:-1]
    alive, same, at = np.ones(shape, bool), np.zeros(shape, np.int16), 0
    for n, least in steps:
        for j in range(at, n):
            same += a[..., j] == b[..., j]
        alive &= same >= least
        at = n
        if not alive.any():
            break
    return alive


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two sides of a unit; the same rows twice where there is one side."""
    side = t.column("side").to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return (left, right) if len(right) else (left, left)


def _apart(t: pa.Table, left: np.ndarray, right: np.ndarray, p: MinHash) -> np.ndarray:
    """Pairs of a unit that are of different components, near enough in size, and counted once."""
    comp, n = t.column("comp").to_numpy(), t.column("n").to_numpy()
    small, large = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
    ok = (comp[left][:, None] != comp[right][None, :]) & (100 * small >= p.percent * large)
    return np.triu(ok, 1) if left is right else ok


def _survivors(t: pa.Table, left: np.ndarray, right: np.ndarray, p: MinHash, steps) -> np.ndarray:
    ok = _apart(t, left, right, p)
    if ok.any():
        sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(-1, p.k)
        ok &= _alive(sig[left][:, None, :], sig[right][None, :, :], steps)
    return ok


def _families(dealt: DataFrame, p: MinHash) -> DataFrame:
    """Forest of surviving comparisons between components (kind 0: src, dst) and the members in one (kind 1: node, comp)."""
    steps = least_matches(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        forest = Forest()
        for t in units(batches):
            left, right = _sides(t)
            ok = _survivors(t, left, right, p, steps)
            if not ok.any():
                continue
            comp, node = t.column("comp").to_numpy(), t.column("node").to_numpy()
            i, j = np.nonzero(ok)
            rows = []
            for a, b in np.unique(np.stack([comp[left[i]], comp[right[j]]], 1), axis=0).tolist():
                if forest.join(a, b):
                    rows.append((0, a, b))
            for r in np.unique(np.concatenate([left[i], right[j]])).tolist():
                if (x := int(node[r])) not in seen:
                    seen.add(x)
                    rows.append((1, x, int(comp[r])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["kind", "src", "dst"])

    return by_unit(dealt).select("unit", "side", "node", "comp", "n", "signature").mapInArrow(run, "kind long, src long, dst long")


def _verified(dealt: DataFrame, p: MinHash) -> DataFrame:
    """Spanning forest of the exact links of each unit: src, dst (nodes)."""
    steps = least_matches(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(batches):
            left, right = _sides(t)
            ok = _survivors(t, left, right, p, steps)
            if not ok.any():
                continue
            node, comp, n = (t.column(c).to_numpy() for c in ("node", "comp", "n"))
            sets = t.column("shingles").combine_chunks()
            off, values = sets.offsets.to_numpy(), sets.values.to_numpy()
            forest, src, dst = Forest(), [], []
            i, j = np.nonzero(ok)
            for a, b in zip(left[i].tolist(), right[j].tolist(), strict=True):
                ca, cb = int(comp[a]), int(comp[b])
                if forest.find(ca) == forest.find(cb):
                    continue
                both = len(np.intersect1d(values[off[a] : off[a + 1]], values[off[b] : off[b + 1]], assume_unique=True))
                if 100 * both >= p.percent * (int(n[a]) + int(n[b]) - both):
                    forest.join(ca, cb)
                    src.append(int(node[a]))
                    dst.append(int(node[b]))
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return by_unit(dealt).select("unit", "side", "node", "comp", "n", "signature", "shingles").mapInArrow(run, "src long, dst long")


def _sets(documents: DataFrame, wanted: DataFrame, p: MinHash) -> DataFrame:
    """Full sets of ``wanted(node, place, digest)``: node, shingles.

    ``place`` is a hash of id and text; whichever rows it finds, the digest tells which of them have the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, digest = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, texts in tk.pieces(batch.column(0)):
                g, d = shingles(texts, p)
                b = tk.per_doc(d, texts.n)
                keep, seen = [], set()
                for q in range(texts.n):
                    if node[i + q] not in seen and xxhash.xxh3_128_digest(g[b[q] : b[q + 1]].tobytes()) == digest[i + q]:
                        seen.add(node[i + q])
                        keep.append(q)
                values = np.concatenate([g[b[q] : b[q + 1]] for q in keep]) if keep else np.zeros(0, tk.U)
                off = np.concatenate([[0], np.cumsum([b[q + 1] - b[q] for q in keep])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([node[i + q] for q in keep], pa.int64()), lists], names=["node", "shingles"])

    texts = documents.select("text", _place()).join(wanted, "place")
    found = texts.select("text", "node", "digest").mapInArrow(run, "node long, shingles array<long>")
    return found.groupBy("node").agg(F.any_value("shingles").alias("shingles"))  # exact copies of a row give its set again


def _place() -> Column:
    return F.xxhash64("doc_id", "text").alias("place")


def _star_units(pairs: DataFrame) -> DataFrame:
    """``pairs(rep, node)`` dealt to units of about ``BLOCK`` nodes: unit, side (0 the representative, 1 the others), node."""
    size = pairs.groupBy("rep").agg(F.count("*").alias("_n"))
    met = pairs.join(size, "rep")
    met = met.withColumn("unit", F.xxhash64("rep", F.expr(f"pmod(xxhash64(node, 17), _n div {BLOCK} + 1)"), F.lit(3)))
    reps = met.groupBy("unit").agg(F.min("rep").alias("node")).select("unit", F.lit(0).alias("side"), "node")
    return reps.unionByName(met.select("unit", F.lit(1).alias("side"), "node"))


def _star_survivors(dealt: DataFrame, p: MinHash) -> DataFrame:
    """The rows of star units that survive the signatures, with their representatives."""
    steps = least_matches(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(batches):
            left, right = _sides(t)
            ok = _survivors(t, left, right, p, steps)
            rows = np.concatenate([left[ok.any(1)], right[ok.any(0)]])
            if len(rows):
                yield from t.select(["unit", "side", "node"]).take(pa.array(rows)).to_batches()

    return by_unit(dealt).select("unit", "side", "node", "comp", "n", "signature").mapInArrow(run, "unit long, side int, node long")


def _with_component(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def near_duplicates(documents: DataFrame, p: MinHash = MinHash(), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, ``keep`` (whole numbers), n_shingles, component_id (least doc_id of the
    component), kept, and component (a number of its own for each component; null for empty sets)."""
    small_batches(documents.sparkSession)
    rows = written(profile(documents, p, keep).withColumn("rid", F.monotonically_increasing_id()), "shingle-profiles")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least_id"))
    classes = written(classes, "classes")
    firsts = rows.select(F.col("rid").alias("node"), "place", "signature", F.col("n_shingles").alias("n"))
    nodes = written(classes.select("node", "digest").join(firsts, "node"), "nodes")

    keyed = _bands(nodes, p)
    shared = keyed.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    buckets = written(keyed.join(shared, "key"), "buckets")
    candidates = written(buckets.select("node").distinct().join(nodes, "node"), "candidates")
    sets = written(_sets(documents, candidates.select("node", "place", "digest"), p), "sets")

    light = candidates.select("node", "n", "signature")
    alone = F.col("node").alias("comp")
    pairs = buckets.where("node <> rep").select("rep", "node").distinct()
    near = written(_star_survivors(_star_units(pairs).join(light, "node").withColumn("comp", alone), p), "star-survivors")
    stars = written(_verified(near.join(light, "node").join(sets, "node").withColumn("comp", alone), p), "star-links")
    comps = components(stars)

    members = _with_component(buckets.select(F.col("key").alias("group"), "node"), comps)
    members = written(members.join(light, "node"), "bucket-members")
    found = written(_families(block_pairs(members), p), "families")
    families = components(found.where("kind = 0").select("src", "dst"))
    inside = found.where("kind = 1").select(F.col("src").alias("node"), F.col("dst").alias("comp")).distinct()
    inside = inside.join(families.toDF("comp", "group"), "comp").join(light, "node").join(sets, "node")
    links = written(_verified(block_pairs(inside), p), "links")
    final = components(stars.union(links))

    # Least id of each component, over all documents of its classes.
    placed = _with_component(classes.select("node", "digest", "least_id"), final)
    least = placed.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    placed = placed.select("comp", "digest").join(least, "comp").select("digest", "component_id", F.col("comp").alias("component"))
    out = rows.select("doc_id", *keep, "n_shingles", "digest").join(placed, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", *keep, "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "component")


def one_of_each(documents: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """``documents`` with one row of each component: the first of those with the least doc_id.

    Rows with empty sets all stay.  Rows are numbered first, and meet their verdicts by number."""
    rows = numbered(documents, "dedup-rows")
    found = settled(lambda: near_duplicates(rows, p, keep=(RID,)).select(RID, "component", "kept"), "near-duplicates")
    first = found.where("component is not null and kept").groupBy("component").agg(F.min(RID).alias(RID)).select(RID)
    stay = found.where("component is null").select(RID).unionByName(first)
    return rows.join(stay, RID, "left_semi").select(*documents.columns)


def op6_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return settled(lambda: near_duplicates(documents).drop("component"), "near-duplicates")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_ids AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_ids ON doc_id = x
"""
