"""Benchmark decontamination: benchmark windows looked up in every document's token windows.

The windows of the benchmark (``words`` consecutive words, or a shorter item as a
whole) and their inner grams are two hash tables that are broadcast.  A window of L
words that stands anywhere in a document covers one of the document's aligned
grams of b = (L + 1) // 2 words (those that begin at a multiple of b), so only
these are hashed and looked up, one for b words.  Around a gram that is found the
b windows whose first aligned gram it is are spelt out and looked up by their
words: that verifies every hit exactly.  A task reads its texts once and passes
on a row per document and one per hit; the only shuffle brings these together.

What is broadcast is counted first: a larger benchmark is cut by hash into
blocks of ``most_windows`` windows and ``most_chars`` characters, and the
documents, numbered and written once, are scanned for one block after the other.
Windows carry the number of the set of items that hold them, so a window of many
items is one row; lists of items are made once for each combination of sets.

``remove_documents`` drops what is contaminated, ``remove_spans`` cuts the hit
words out.  Only DataFrame expressions are used.

Edge cases: a null or empty text, or one without words, has no words and no
hits, an item without words no window; repeated documents are judged one by
one, null ids too; items that share an id are one item, those without an id one
with an empty name; a short item is hit as a whole only; empty tables give no
rows or no hits; other columns are ignored, and kept by the removals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import RID, numbered, settled, table, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of what is no word character, before and after A-Z are lower-cased.
GAP, GAP_LOWERED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPANS = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Overlap:
    """Parameters of the method."""

    words: int = 10  # of a window
    most_windows: int = 400_000  # of a block of the benchmark, which is broadcast
    most_chars: int = 48 << 20  # of a block
    most_found: int = 400_000  # rows of found documents or combinations that are broadcast


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def lowered_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), GAP_LOWERED), "")


def gram_words(window_words: int) -> int:
    return (window_words + 1) // 2


def _joined(words: Column, start: Column, n: int) -> Column:
    return F.array_join(F.slice(words, start + 1, F.lit(n)), " ")


def _gram_hash(words: Column, at: Column, n: int) -> Column:
    b = gram_words(n)
    return F.xxhash64(F.lit(n), *(F.get(words, at + i) for i in range(b)))


class Windows:
    """The benchmark's windows by number of words, with the sets of items that hold them."""

    def __init__(self, benchmark: DataFrame, p: Overlap):
        self.p = p
        items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), lowered_words(F.col("text")).alias("w")).where(F.size("w") > 0)
        n = F.least(F.size("w"), F.lit(p.words))
        every = items.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("at"))
        spelt = every.select("item", "n", F.slice("w", F.col("at") + 1, F.col("n")).alias("w"))
        held = written(spelt.groupBy("n", "w").agg(F.sort_array(F.collect_set("item")).alias("items")), "benchmark-held")
        self.sets = written(held.select("items").distinct().withColumn("set", F.monotonically_increasing_id()), "benchmark-sets")
        windows = held.join(self.sets, "items").select("n", "w", F.array_join("w", " ").alias("window"), "set")
        size = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.array_join("w", " "))), F.lit(0)).alias("chars"), F.sort_array(F.collect_set("n")).alias("lengths")).first()
        self.blocks = max(1, -(-size["n"] // p.most_windows), -(-size["chars"] // p.most_chars))
        self.lengths = list(size["lengths"])
        self.table = written(windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(self.blocks))), "benchmark-windows")

    def block(self, i: int) -> tuple[DataFrame, DataFrame]:
        """Windows (window, set) of one block, and the hashes of their inner grams that may be a document's aligned ones."""
        rows = self.table.where(F.col("block") == i)

        def hashes(n: int) -> DataFrame:
            inner = F.transform(F.sequence(F.lit(0), F.lit(gram_words(n) - 1)), lambda at: _gram_hash(F.col("w"), at, n))
            return rows.where(F.col("n") == n).select(F.explode(inner).alias("hash"))

        none = rows.select(F.lit(0).cast("long").alias("hash")).where("false")
        return rows.select("window", "set"), reduce(DataFrame.union, map(hashes, self.lengths), none).distinct().withColumn("known", F.lit(True))


def _grams(words: Column, n: int) -> Column:
    """The aligned grams of a document for windows of ``n`` words: where they begin, hash, and the words of the windows whose first one they are."""
    b = gram_words(n)

    def gram(at: Column) -> Column:
        first = F.greatest(at - (b - 1), F.lit(0))
        return F.struct(F.lit(n).alias("n"), first.alias("first"), at.alias("at"), _gram_hash(words, at, n).alias("hash"), F.slice(words, first + 1, at - first + n).alias("around"))

    none = F.array().cast("array<struct<n:int,first:int,at:int,hash:bigint,around:array<string>>>")
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - b, F.lit(b)), gram)).otherwise(none)


def _candidates(gram: Column, lengths: list[int]) -> Column:
    """Start and spelling of the windows around a gram that was found."""

    def of(n: int) -> Column:
        starts = F.filter(F.sequence(gram["first"], gram["at"]), lambda s: s - gram["first"] + n <= F.size(gram["around"]))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), (s + n).alias("end"), _joined(gram["around"], s - gram["first"], n).alias("window")))

    return reduce(lambda rest, n: F.when(gram["n"] == n, of(n)).otherwise(rest), lengths, F.lit(None).cast("array<struct<start:int,end:int,window:string>>"))


def _scan(rows: DataFrame, windows: Windows, block: int) -> DataFrame:
    """rid, doc_id, n_words and one hit (start, end, set) a row; of block 0 also a row without hit for every document."""
    spelt, hashes = windows.block(block)
    none = F.array().cast("array<struct<n:int,first:int,at:int,hash:bigint,around:array<string>>>")
    taken = let(lowered_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), F.concat(none, *(_grams(w, n) for n in windows.lengths)).alias("grams")))
    grams = rows.select("rid", "doc_id", taken.alias("t")).select("rid", "doc_id", F.col("t.n_words").alias("n_words"), F.posexplode_outer("t.grams").alias("nth", "gram"))
    head = F.coalesce(F.col("nth"), F.lit(0)) == 0
    keep_head = head if block == 0 else F.lit(False)
    known = grams.withColumn("hash", F.col("gram.hash")).join(F.broadcast(hashes), "hash", "left").where(F.col("known") | keep_head)
    around = F.when(F.col("known"), _candidates(F.col("gram"), windows.lengths))
    tried = known.select("rid", "doc_id", "n_words", head.alias("head"), F.posexplode_outer(around).alias("nth", "c")).withColumn("window", F.col("c.window"))
    keep_head = F.col("head") & (F.coalesce(F.col("nth"), F.lit(0)) == 0) if block == 0 else F.lit(False)
    found = tried.join(F.broadcast(spelt), "window", "left").where(F.col("set").isNotNull() | keep_head)
    return found.select("rid", "doc_id", "n_words", F.when(F.col("set").isNotNull(), F.struct(F.col("c.start").alias("start"), F.col("c.end").alias("end"))).alias("hit"), "set")


def _merged(hits: Column) -> Column:
    """Hits as disjoint spans of words, in order: the last one stays open until a hit begins beyond its end."""

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] > acc["end"]
        done = F.when(apart & (acc["end"] > 0), F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(apart | (acc["end"] == 0), s["start"]).otherwise(acc["start"]).alias("start"), F.greatest(acc["end"], s["end"]).alias("end"))

    last = lambda acc: F.when(acc["end"] > 0, F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["done"])
    none = F.struct(F.array().cast(SPANS).alias("done"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(hits), none, step, last)


def overlaps(rows: DataFrame, windows: Windows) -> DataFrame:
    """rid, doc_id, n_words, spans (of hit words) and sets (of items) of every row of ``rows(rid, doc_id, text)``; rid differs from row to row."""
    scans = [_scan(rows, windows, i) for i in range(windows.blocks)]
    gathered = reduce(DataFrame.unionByName, scans).groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.sort_array(F.collect_set("set")).alias("sets")
    )
    return gathered.select("rid", "doc_id", "n_words", _merged(F.col("hits")).alias("spans"), "sets")


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` to be broadcast, if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_items(found: DataFrame, windows: Windows) -> DataFrame:
    """``found`` (written) with items: the names of the items whose windows occur, in order, made once for each combination of sets."""
    kinds = found.where(F.size("sets") > 0).select("sets").distinct()
    each = kinds.select("sets", F.explode("sets").alias("set")).join(windows.sets, "set").select("sets", F.explode("items").alias("item"))
    items = written(each.groupBy("sets").agg(F.sort_array(F.collect_set("item")).alias("items")), "benchmark-items")
    none = F.array().cast("array<string>")
    clear = found.where(F.size("sets") == 0).withColumn("items", none)
    return clear.unionByName(found.where(F.size("sets") > 0).join(_bounded(items, windows.p.most_found), "sets"))


def find_overlaps(documents: DataFrame, benchmark: DataFrame, p: Overlap = Overlap()) -> DataFrame:
    """doc_id, n_words, spans (start and end of runs of hit words) and items of every document."""
    windows = Windows(benchmark, p)
    rows = documents.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    if windows.blocks > 1:  # scanned more than once: numbers must stay
        rows = written(rows, "decontamination-rows")
    found = written(overlaps(rows, windows), "decontamination-hits")
    return with_items(found, windows).select("doc_id", "n_words", "spans", "items")


def _contaminated(documents: DataFrame, benchmark: DataFrame, p: Overlap) -> tuple[DataFrame, DataFrame]:
    """The rows numbered, and number and spans of the contaminated ones."""
    rows = numbered(documents, "decontamination-rows")
    found = written(overlaps(rows.select(F.col(RID).alias("rid"), "doc_id", "text"), Windows(benchmark, p)), "decontamination-hits")
    hit = found.where(F.size("spans") > 0).select(F.col("rid").alias(RID), F.col("spans").alias("__foliant_spans"))
    return rows, _bounded(hit, p.most_found)


def remove_documents(documents: DataFrame, benchmark: DataFrame, p: Overlap = Overlap()) -> DataFrame:
    """``documents`` without those that hold a window of the benchmark."""
    rows, hit = _contaminated(documents, benchmark, p)
    return rows.join(hit, RID, "left_anti").select(*documents.columns)


def remove_spans(documents: DataFrame, benchmark: DataFrame, p: Overlap = Overlap()) -> DataFrame:
    """``documents`` without the hit words and what stands between and behind them up to the next word; n_chars follows, other columns stay."""
    rows, hit = _contaminated(documents, benchmark, p)
    text, spans = F.col("text"), F.col("__foliant_spans")
    words, gaps = F.array_remove(F.split(text, GAP), ""), F.split(text, GAP.replace("[", "[^", 1), -1)

    def cut(units: Column) -> Column:
        """``units``: what stands before the first word, then every word with what follows it."""
        n = F.size(spans)
        between = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"] + 1).alias("a"), F.when(i == n, F.size(units)).otherwise(F.get(spans, i)["start"] + 1).alias("b")))
        return F.array_join(F.flatten(F.transform(between, lambda s: F.slice(units, s["a"] + 1, s["b"] - s["a"]))), "")

    units = let(F.struct(gaps.alias("g"), words.alias("w")), lambda x: F.concat(F.slice(x["g"], 1, 1), F.zip_with(x["w"], F.slice(x["g"], 2, F.size(x["w"])), lambda w, g: F.concat(w, g))))
    dirty = rows.join(hit, RID).withColumn("text", let(units, cut))
    if "n_chars" in documents.columns:
        dirty = dirty.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return rows.join(hit, RID, "left_anti").select(*documents.columns).unionByName(dirty.select(*documents.columns))


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"]).cast("long")
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def op11_broadcast_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return settled(lambda: digest(find_overlaps(documents.select("doc_id", "text"), benchmark.select("item_id", "text"))), "decontaminated")


_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{GAP_LOWERED}'), lambda x: x <> '')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
b AS (SELECT DISTINCT item, n, array_to_string(w[s + 1 : s + n], ' ') AS x FROM (SELECT item, n, w, unnest(range(len(w) - n + 1)) AS s FROM i)),
t AS (SELECT rid, n, s, array_to_string(w[s + 1 : s + n], ' ') AS x
  FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
h AS (SELECT rid, s, t.n, item FROM t JOIN b USING (x)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM h) GROUP BY rid),
listed AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)
"""
