"""Mixing sources to target weights: blocks, multinomial shard counts, index permutations.

Each source's documents are laid end to end as one stream of words and packed
into blocks of a fixed length.  The mix is a sequence of slots, one block each,
dealt out in output shards.  For every shard the number of slots of each source
is a multinomial draw with the sources' target shares as probabilities; what a
source draws beyond its quota is cut, and what it lacks is made up in balancing
shards, so that every source meets its target to the word.  A source's running
slot number gives the pass over its stream and, through a pseudorandom
permutation of its block indexes (a swap-or-not shuffle, a bijection for any
number of blocks), the block; blocks are joined by index.  A pass holds each
block once and a target is at most twice the source, so no document is taken
more than twice.  The last slot of a source takes the part of a block that is
left of the quota, and the one short block of a stream comes last in its pass.

Only DataFrame expressions are used.  A hot source is laid out in hashed
buckets of some ``bucket_words`` words; a window runs over one bucket's rows,
and a second one over bucket totals.  All draws are hashes of the seed and
indexes: reruns and retried tasks agree.

Edge cases: null or empty text has size 0 and takes 0; a null source is a source
of its own, last in order; repeated rows are laid out one by one; an empty table
gives no rows; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import RID, WORD, numbered, settled, table, written


@dataclass(frozen=True)
class Mixture:
    """Parameters of the mix."""

    weights: tuple[int, ...] = (3, 1, 2)  # of the sources in code point order, repeating; a null source last
    total_share: float = 1.5  # words of the mix for each word of input
    most_repeats: int = 2  # a target is at most so many times its source
    block_words: int = 512
    shard_slots: int = 1024
    bucket_words: int = 1 << 18
    group_shards: int = 1024  # shards whose draws one window sums
    task_slots: int = 1 << 16  # slots that one task permutes, about
    rounds: int = 20  # of the permutation
    seed: int = 20
    broadcast_rows: int = 100_000  # the table of draw intervals is broadcast up to so many rows


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, m: Mixture) -> DataFrame:
    """One row per source: source, rank, source_size, target.

    Reshares until no target is above its limit, in closed form: with sources
    ordered by limit / weight, the level is the largest (total - limits of the
    first k) / (weights of the rest), and a target is weight * level or its limit."""
    every, by_fill = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("_fill", "rank")
    weight = F.element_at(F.array(*map(F.lit, m.weights)), (F.col("rank") % len(m.weights) + 1).cast("int")).cast("double")
    s = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", (F.row_number().over(every) - 1).cast("long"))
        .withColumn("_w", weight)
        .withColumn("_limit", (F.col("source_size") * m.most_repeats).cast("double"))
        .withColumn("_fill", F.col("_limit") / F.col("_w"))
    )
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    all_rows = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("_total", F.sum("source_size").over(all_rows) * m.total_share)
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    s = s.withColumn("_level", F.max("_level").over(all_rows))
    return s.select("source", "rank", "source_size", F.least(F.col("_limit"), F.col("_w") * F.col("_level")).alias("target"))


def quotas(sources: DataFrame, m: Mixture) -> DataFrame:
    """Adds words (the quota), blocks, slots (and rest: words of the partial pass) to each source."""
    b = m.block_words
    q = sources.withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * m.most_repeats))
    q = q.withColumn("blocks", F.expr(f"(source_size + {b - 1}) div {b}"))
    q = q.withColumn("rest", F.when(F.col("source_size") > 0, F.expr("words % source_size")).otherwise(F.lit(0)).cast("long"))
    full = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)).cast("long")
    return q.withColumn("slots", full * F.col("blocks") + F.expr(f"(rest + {b - 1}) div {b}"))


def shard_counts(spark: SparkSession, q: DataFrame, m: Mixture) -> DataFrame:
    """Slots of each source in each output shard: rank, shard, first (running slot number), count."""
    sums = q.agg(F.count("*").alias("k"), F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()
    k, n = sums["k"], sums["n"]
    cells = 4 * max(k, 1)
    upto = F.sum("slots").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)) / F.lit(float(max(n, 1)))
    at = q.where("slots > 0").select("rank", upto.alias("hi"), (upto - F.col("slots") / F.lit(float(max(n, 1)))).alias("lo"))
    at = at.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("rank")), F.lit(0.0)))
    at = at.withColumn("hi", F.coalesce(F.lead("lo").over(W.orderBy("rank")), F.lit(1.0)))
    last = F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1))
    at = at.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), last)))
    if cells + k <= m.broadcast_rows:
        at = F.broadcast(at)  # at most cells + k rows, as checked
    u = F.xxhash64(F.lit(m.seed), F.lit("draw"), F.col("id")).bitwiseAND(F.lit((1 << 48) - 1)) / F.lit(float(1 << 48))
    drawn = (
        spark.range(n)
        .select(F.expr(f"id div {m.shard_slots}").alias("shard"), u.alias("u"))
        .withColumn("cell", F.least(F.floor(F.col("u") * cells), F.lit(cells - 1)))
        .join(at, "cell")
        .where("u >= lo and u < hi")
        .groupBy("rank", "shard")
        .agg(F.count("*").alias("count"))
    )
    # What is drawn in earlier shards comes first; a source's draws end at its quota.  Sums run over groups of shards, then inside.
    drawn = written(drawn.withColumn("_group", F.expr(f"shard div {m.group_shards}")), "mix-draws")
    before = (W.unboundedPreceding, -1)
    groups = drawn.groupBy("rank", "_group").agg(F.sum("count").alias("_n"))
    groups = groups.select("rank", "_group", F.coalesce(F.sum("_n").over(W.partitionBy("rank").orderBy("_group").rowsBetween(*before)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("count").over(W.partitionBy("rank", "_group").orderBy("shard").rowsBetween(*before)), F.lit(0))
    totals = drawn.groupBy("rank").agg(F.sum("count").alias("drawn"))
    drawn = drawn.withColumn("_in", inside).join(groups, ["rank", "_group"]).withColumn("first", F.col("_start") + F.col("_in"))
    lacking = (
        q.join(totals, "rank", "left")
        .withColumn("first", F.least(F.coalesce("drawn", F.lit(0)), F.col("slots")))
        .where("slots > first")
        .select("rank", F.expr(f"{(n + m.shard_slots - 1) // m.shard_slots} + rank").alias("shard"), "first", (F.col("slots") - F.col("first")).alias("count"))
    )
    cut = drawn.join(q.select("rank", "slots"), "rank").where("first < slots")
    cut = cut.select("rank", "shard", "first", F.least(F.col("count"), F.col("slots") - F.col("first")).alias("count"))
    return cut.unionByName(lacking)


def permuted(pos: Column, n: Column, key: tuple[Column, ...], m: Mixture) -> Column:
    """Swap-or-not shuffle of [0, n): a bijection for every n and key."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(m.seed), F.lit("key"), r, *key), n) - x, n)
        coin = F.xxhash64(F.lit(m.seed), F.lit("coin"), r, *key, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(m.rounds - 1)), pos, step)


def mix_slots(spark: SparkSession, q: DataFrame, m: Mixture) -> DataFrame:
    """The mix: rank, shard, slot (of the source), pass, block, length (words from the block's start)."""
    b = m.block_words
    total = q.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    tasks = int(max(1, min(max(spark.sparkContext.defaultParallelism, total // m.task_slots), total // m.shard_slots)))
    # Rows of counts are few and small, their slots many: cut into pieces (a balancing shard can be long) and dealt out before they are opened.
    counts = shard_counts(spark, q, m).select("*", F.explode(F.expr(f"sequence(0, (count - 1) div {m.shard_slots})")).alias("_i"))
    low = F.expr(f"first + _i * {m.shard_slots}")
    counts = counts.select("rank", "shard", low.alias("low"), F.least(low + m.shard_slots, F.col("first") + F.col("count")).alias("high"))
    s = counts.repartition(tasks, "rank", "shard", "low").select("rank", "shard", F.explode(F.expr("sequence(low, high - 1)")).alias("slot"))
    s = s.join(q.select("rank", "source_size", "blocks", "slots", "rest"), "rank")
    s = s.withColumn("pass", F.expr("slot div blocks")).withColumn("_pos", F.expr("slot % blocks"))
    short = F.col("blocks") - 1  # the last block keeps its place at the end of a pass
    s = s.withColumn("block", F.when(F.col("_pos") < short, permuted(F.col("_pos"), short, (F.col("rank"), F.col("pass")), m)).otherwise(short))
    size = F.least(F.lit(b).cast("long"), F.col("source_size") - F.col("block") * b)
    size = F.when((F.col("slot") == F.col("slots") - 1) & (F.col("rest") > 0), F.least(size, F.col("rest") - F.col("_pos") * b)).otherwise(size)
    return s.select("rank", "shard", "slot", "pass", "block", size.alias("length"))


def layout(sized: DataFrame, q: DataFrame, m: Mixture) -> DataFrame:
    """Adds rank and offset (words before it in its source's stream) to ``sized(rid, doc_id, source, size)``."""
    d = sized.join(q.select("source", "rank", "source_size", "target"), sized["source"].eqNullSafe(q["source"])).drop(q["source"])
    mixed = F.xxhash64(F.lit(m.seed), F.lit("order"), "doc_id", "size")
    d = d.withColumn("_order", mixed).withColumn("_bucket", F.expr(f"pmod(_order, source_size div {m.bucket_words} + 1)"))
    starts = d.groupBy("rank", "_bucket").agg(F.sum("size").alias("_words"))
    starts = starts.select("rank", "_bucket", F.coalesce(F.sum("_words").over(W.partitionBy("rank").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = W.partitionBy("rank", "_bucket").orderBy("_order", "doc_id", "size", "rid").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.join(starts, ["rank", "_bucket"]).withColumn("offset", F.col("_start") + F.col("_before")).drop("_order", "_bucket", "_start", "_before")


def taken_ranges(placed: DataFrame, slots: DataFrame, m: Mixture) -> DataFrame:
    """Blocks joined by index: rid, pass, and the words [from, upto) of the document that the pass takes."""
    b = m.block_words
    parts = placed.where("size > 0").select(
        "rid", "rank", "offset", "size", F.explode(F.expr(f"sequence(offset div {b}, (offset + size - 1) div {b})")).alias("block")
    )
    low = F.greatest(F.col("offset"), F.col("block") * b)
    high = F.least(F.col("offset") + F.col("size"), F.col("block") * b + F.col("length"))
    hit = parts.join(slots, ["rank", "block"]).withColumn("_low", low).withColumn("_high", high).where("_high > _low")
    return hit.select("rid", "pass", (F.col("_low") - F.col("offset")).alias("from"), (F.col("_high") - F.col("offset")).alias("upto"))


def mix(spark: SparkSession, rows: DataFrame, m: Mixture = Mixture()) -> tuple[DataFrame, DataFrame]:
    """Mix ``rows(rid, doc_id, source, size)``, ``rid`` unique.

    Returns the rows with source_size and target, and the word ranges taken of each."""
    q = written(quotas(targets(rows, m), m), "mix-quotas")
    placed = layout(rows, q, m)
    return placed, taken_ranges(placed, mix_slots(spark, q, m), m)


def mix_documents(documents: DataFrame, m: Mixture = Mixture()) -> DataFrame:
    """How much of each document the mix takes: doc_id, size, source_size, target, taken."""
    spark = documents.sparkSession
    rows = documents.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = written(rows, "mix-sizes")
    placed, ranges = mix(spark, rows, m)
    taken = ranges.groupBy("rid").agg(F.sum(F.col("upto") - F.col("from")).alias("taken"))
    return placed.join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, m: Mixture = Mixture()) -> DataFrame:
    """The mix itself, with the columns of ``documents``: one row per document and pass with the words taken.

    A document that a pass takes whole keeps its text; of others the taken words
    stand with single spaces.  n_chars follows the text.  Rows are numbered, and
    meet their ranges by number."""
    spark = documents.sparkSession
    numbers = numbered(documents, "mix-rows", __foliant_size=word_count(F.col("text")))
    rows = numbers.select(F.col(RID).alias("rid"), "doc_id", "source", F.col("__foliant_size").alias("size"))
    _, ranges = mix(spark, rows, m)
    ranges = ranges.groupBy("rid", "pass").agg(F.array_sort(F.collect_list(F.struct("from", "upto"))).alias("__foliant_ranges"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    taken = F.aggregate("__foliant_ranges", F.lit(0).cast("long"), lambda n, r: n + r["upto"] - r["from"])
    some = F.flatten(F.transform("__foliant_ranges", lambda r: F.slice(words, (r["from"] + 1).cast("int"), (r["upto"] - r["from"]).cast("int"))))
    out = numbers.join(ranges.select(F.col("rid").alias(RID), "__foliant_ranges"), RID)
    out = out.withColumn("text", F.when(taken == F.col("__foliant_size"), F.col("text")).otherwise(F.array_join(some, " ")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return settled(lambda: mix_documents(documents), "mix")
