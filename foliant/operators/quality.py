"""Duplicates, boilerplate, quality reports and the document registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.pairs import paired
from foliant.sources.scratch import written

#: Boilerplate lines that are sent to every task; more are dealt to SALTS tasks each.
BROADCAST_LINES = 200_000
SALTS = 32

#: Money amounts and labelled fields are never boilerplate.
PROTECTED = r"(?:₹|Rs\.?|INR|\$|€|£)\s?[0-9]|(?:^|[^0-9A-Za-z_])[0-9][0-9,]*\.[0-9]{1,2}(?:$|[^0-9A-Za-z_])|[:|]"


def first_of(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """The row of least ``order`` (unique) of each key; partial minima, so a key with most rows costs one row per task."""
    least = rows.groupBy(key.alias("_k")).agg(F.min(order).alias("_o")).select("_o")
    return rows.withColumn("_o", order).join(least, "_o", "left_semi").drop("_o")


def last_of(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    most = rows.groupBy(key.alias("_k")).agg(F.max(order).alias("_o")).select("_o")
    return rows.withColumn("_o", order).join(most, "_o", "left_semi").drop("_o")


def unseen(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(stored.select(key).distinct(), key, "left_anti")


def lines(pages: DataFrame, group: str, page: str, text: str) -> DataFrame:
    split = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"\s", "") != "")
    return pages.select(F.col(group).alias("group"), F.col(page).alias("page"), F.posexplode(split).alias("n", "line"))


def boilerplate(pages: DataFrame, group: str, page: str, text: str, share: float = 0.6, least_pages: int = 3, least_chars: int = 12) -> DataFrame:
    """group, line (lower case), pages: lines that stand on most pages of a document.

    Pages are counted once per line, whatever its case."""
    every = lines(pages, group, page, text)
    counted = every.groupBy("group", F.lower("line").alias("line"), "page").agg(F.lit(1).alias("_one")).groupBy("group", "line").agg(F.count("*").alias("pages"))
    sizes = pages.groupBy(F.col(group).alias("group")).agg(F.countDistinct(page).alias("_total"))
    found = counted.join(sizes, "group").where(F.col("_total") >= least_pages)
    enough = F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("_total") * share))
    return found.where(enough & (F.length("line") >= least_chars) & ~F.col("line").rlike(PROTECTED)).drop("_total")


def _marked(every: DataFrame, drop: DataFrame) -> DataFrame:
    """``every`` line with _drop.  A boilerplate line stands on most pages, so equal lines never meet in one task."""
    if drop.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        return every.join(F.broadcast(drop), ["group", "_low"], "left")
    salted = every.withColumn("_salt", F.pmod(F.xxhash64("page", "n"), F.lit(SALTS)))
    copies = drop.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["group", "_low", "_salt"], "left").drop("_salt")


def without_boilerplate(pages: DataFrame, group: str, page: str, text: str, share: float = 0.6, floor_share: float = 0.15, floor_chars: int = 0, **limits) -> DataFrame:
    """group, page, text, removed.  A page that would lose nearly everything stays as it was."""
    drop = written(boilerplate(pages, group, page, text, share, **limits).select("group", F.col("line").alias("_low"), F.lit(True).alias("_drop")), "boilerplate")
    marked = _marked(lines(pages, group, page, text).withColumn("_low", F.lower("line")), drop)
    parts = marked.groupBy("group", "page").agg(F.array_sort(F.collect_list(F.struct("n", "line", F.coalesce("_drop", F.lit(False)).alias("gone")))).alias("l"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["line"]), "\n")
    whole, kept = joined(F.col("l")), joined(F.filter("l", lambda x: ~x["gone"]))
    removed = F.size(F.filter("l", lambda x: x["gone"]))
    short = F.length(kept) < F.greatest(F.lit(float(floor_chars)), floor_share * F.length(whole))
    use = (removed > 0) & ~short
    cleaned = parts.select("group", "page", F.when(use, kept).otherwise(whole).alias("_clean"), F.when(use, removed).otherwise(0).alias("removed"))
    out = pages.select(F.col(group).alias("group"), F.col(page).alias("page"), F.col(text).alias("_text")).join(cleaned, ["group", "page"], "left")
    return out.select("group", "page", F.when(F.col("removed") > 0, F.col("_clean")).otherwise(F.col("_text")).alias("text"), F.coalesce("removed", F.lit(0)).alias("removed"))


def is_noise(text: Column, floor: int = 0) -> Column:
    """No letter or digit, or shorter than the floor (0: any length)."""
    return ~text.rlike(r"[\p{L}\p{N}]") | ((F.lit(floor) > 0) & (F.length(text) < floor))


def is_overcleaned(raw: Column, clean: Column, share: float = 0.15, least: int = 100) -> Column:
    """Cleaning took most of a page; pages without a measure, and short ones, are not judged."""
    return F.coalesce((raw >= least) & (clean / raw < share), F.lit(False))


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The registry behind an append-only log: the last entry of each key."""
    rest = [c for c in log.columns if c not in (key, *order)]
    last = log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(key, *(F.col("_last")[c].alias(c) for c in (*order, *rest)))


def drift(registry: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Which documents are on one side only: key, state (both, registry_only, store_only)."""
    a = registry.select(key).distinct().withColumn("_a", F.lit(True))
    b = store.select(key).distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_a").isNull(), "store_only").when(F.col("_b").isNull(), "registry_only").otherwise("both")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def current(log: DataFrame, key: str, *order: str, removed: Column, cleared: Column) -> DataFrame:
    """The registry behind a log of upserts, removals and clearings: entries since the last clearing, not removed."""
    marked = log.withColumn("_o", F.struct(*order)).withColumn("_gone", removed).withColumn("_all", cleared)
    wiped = marked.where("_all").agg(F.max("_o").alias("_w"))
    since = marked.where("not _all").join(F.broadcast(wiped), F.lit(True)).where("_w is null or _o > _w").drop("_w", "_all")
    last = since.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key], "_gone"), "_o").alias("x")).select(key, "x.*")
    return last.where("not _gone").drop("_gone")


def replaced_by(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """document_id, by: entries whose chunks go when ``incoming(document_id, filename)`` comes in.

    An entry goes if it has the id, or the file name under an older id.  Pairs are as many as names are shared, so they are
    never compared with each other, but made of blocks: they differ by how they are made, except for ids that have several names."""
    new = written(incoming.select("filename", F.col("document_id").alias("by")).distinct(), "registry-new")
    old = registry.select("document_id", "filename").distinct()
    same_id = old.select("document_id").distinct().join(new.select(F.col("by").alias("document_id")).distinct(), "document_id", "left_semi").select("document_id", F.col("document_id").alias("by"))
    names = written(old.groupBy("document_id").agg(F.min("filename").alias("filename"), F.count("*").alias("_names")), "registry-names")
    other = F.col("document_id") != F.col("by")
    one = paired(names.where("_names = 1").drop("_names"), new, ["filename"]).where(other).select("document_id", "by")
    several = old.join(names.where("_names > 1").select("document_id"), "document_id", "left_semi").join(new, "filename").where(other).select("document_id", "by").distinct()
    return one.union(several).union(same_id)


def restored(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, filename, pages, chunks, origin (registry or backfilled): the registry after a restart.

    Entries without chunks go; documents that only the chunks know get an entry from them."""
    store = chunks.where(F.coalesce(F.col("document_id"), F.lit("")) != "").groupBy("document_id")
    store = store.agg(F.min("filename").alias("_name"), F.countDistinct("page_number").alias("_pages"), F.count("*").alias("_chunks"))
    known = registry.select("document_id", "filename", "pages", "chunks", F.lit("registry").alias("origin"))
    both = store.join(known, "document_id", "left")
    pick = lambda c, d: F.when(F.col("origin").isNull(), F.col(d)).otherwise(F.col(c)).alias(c)
    return both.select("document_id", pick("filename", "_name"), pick("pages", "_pages"), pick("chunks", "_chunks"), F.coalesce("origin", F.lit("backfilled")).alias("origin"))
