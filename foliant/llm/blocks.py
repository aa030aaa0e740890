"""All pairs inside groups, in block pairs of bounded size, without emitting pairs.

Members of a group that carry the same component are known to be connected, so
only pairs across components matter.  A component with many members in a group
gets blocks of its own, the others share hashed blocks; two blocks of one
component are never compared.  Each block pair is one unit of work, whatever
the group's size, and reaches one task whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def block_pairs(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``members(group, node, comp, ...)`` dealt to units: adds unit and side (0 or 1; 0 alone: pairs within).

    Groups that hold one component only are left out."""
    by_comp = members.groupBy("group", "comp").agg(F.count("*").alias("_n")).withColumn("_large", F.col("_n") >= block)
    by_group = by_comp.groupBy("group").agg(
        F.count("*").alias("_comps"), F.coalesce(F.sum(F.when(~F.col("_large"), F.col("_n"))), F.lit(0)).alias("_small"), F.max("_large").alias("_any")
    )
    # Small components share blocks; a large one is cut by node, and its blocks carry its name as `pure`.
    # Members meet this by group and component, so a large group's rows spread.
    info = by_comp.join(by_group.where("_comps > 1"), "group").select(
        "group", "comp", "_n", "_large", (~F.col("_any") & (F.col("_small") <= block)).alias("_lone"), F.expr(f"pmod(xxhash64(comp, 11), _small div {block} + 1)").alias("_shared")
    )
    own = F.expr(f"pmod(xxhash64(node, 13), _n div {block} + 1)")
    m = members.join(info, ["group", "comp"]).withColumn("_pure", F.when(F.col("_large"), F.col("comp")))
    m = m.withColumn("_blk", F.when(F.col("_lone"), F.lit(0)).when(F.col("_large"), own).otherwise(F.col("_shared")))
    keep = [c for c in members.columns]
    alone = m.where("_lone").select(*keep, F.xxhash64("group", F.lit(0)).alias("unit"), F.lit(0).alias("side"))
    many = m.where("not _lone").withColumn("_id", F.xxhash64("_blk", F.coalesce("_pure", F.lit(-1))))
    blocks = many.groupBy("group", "_id", "_pure").agg(F.lit(1).alias("_one")).drop("_one")
    a = blocks.select("group", F.col("_id").alias("_a"), F.col("_pure").alias("_pa"))
    b = blocks.select("group", F.col("_id").alias("_b"), F.col("_pure").alias("_pb"))
    pairs = a.join(b, "group").where("_a <= _b and not coalesce(_pa = _pb, false)")
    pairs = pairs.withColumn("unit", F.xxhash64("group", "_a", "_b"))
    sides = pairs.select("group", F.col("_a").alias("_id"), "unit", F.lit(0).alias("side")).union(
        pairs.where("_a < _b").select("group", F.col("_b").alias("_id"), "unit", F.lit(1).alias("side"))
    )
    return alone.unionByName(many.join(sides, ["group", "_id"]).select(*keep, "unit", "side"))


def by_unit(dealt: DataFrame) -> DataFrame:
    """Units whole and together, for ``units`` below."""
    return dealt.repartition("unit").sortWithinPartitions("unit", "side", "node")


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one unit after the other from batches sorted by unit."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column("unit").to_numpy()
        cuts = [0, *((unit[1:] != unit[:-1]).nonzero()[0] + 1).tolist(), len(unit)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(i, j - i)
            if held and held[0].column("unit")[0].as_py() != int(unit[i]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
