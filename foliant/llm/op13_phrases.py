"""Phrase collocations by count tries of bounded depth, made per shard and merged by prefix range.

1. A task cuts its texts into pieces and words and builds a trie of depth ``DEPTH``
   for each shard of about ``shard_tokens`` words.  A trie is kept as its leaves:
   at every word the window of up to four words that begins there, distinct, with
   counts, in byte order (language, words).  Sorting is by doubling: bigrams get
   ranks, and a leaf is the pair of the ranks at a word and two words on.
2. Leaves are serialised in that order and cut at the same places in every shard:
   prefix ranges, chosen from a sample of windows so that each has about equally
   many leaves.  (The sample moves the cuts, never a result.)  Every range is
   merged from its sorted runs.  A node is a run of leaves that share its words,
   its count their sum, so one walk over the merged leaves gives each node's count
   and, from its ancestors, the counts of its left parts.
3. A node of at least ``least`` occurrences is emitted.  Only the nodes on the path
   of a range's first and last leaf may go on in another range: these are emitted
   whatever their count, and summed.
4. Suffix links give the right parts: a node meets the node of its words without
   the first, level by level, and takes over its count and its right parts.

A prefix of a third of all rows is spread over many ranges, as these are cut
anywhere in the order of leaves; equal windows of a shard are one leaf.  A part
of a frequent phrase is at least as frequent, so rare nodes are never needed.

Edge cases: a null or empty text has no words; a null language is ``und``, also
beside a real ``und``; repeated rows count each time; phrases never cross a piece
or a document; a text's memory follows its length; an empty table, or one
without frequent phrases, gives no rows; columns other than text and lang are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import settled, small_batches, table, written

DEPTH = 4
#: Kinds of bytes: of words, between words, between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


@dataclass(frozen=True)
class Phrases:
    """Parameters of the method."""

    least: int = 30  # occurrences of a phrase
    covered_percent: int = 80  # of a phrase's occurrences inside a longer one: it goes
    scale: int = 2_000_000
    top: int = 2000  # of each language
    shard_tokens: int = 1 << 20
    range_bytes: int = 6 << 20  # of text, whose leaves are merged at a time
    most_ranges: int = 1 << 16
    sampled: int = 64  # windows of the sample for each range
    stride: int = 16  # one window in so many of a sampled text
    most_sent: int = 400_000  # rows of a table that is broadcast


def words_of(texts: tk.Texts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words (binary), the number of each one's piece, and of its document."""
    low = texts.lowered()
    kind = KIND[low.data]
    inside = kind == 0
    spans = low._cut(inside)
    offsets = np.zeros(len(spans.starts) + 1, np.int32)
    np.cumsum(spans.ends - spans.starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(spans.starts), [None, pa.py_buffer(offsets), pa.py_buffer(low.data[inside])])
    marks = np.cumsum(kind == 2)[spans.starts] if len(spans.starts) else np.zeros(0, np.int64)
    new = np.ones(len(marks), np.int64)
    new[1:] = (marks[1:] != marks[:-1]) | (spans.doc[1:] != spans.doc[:-1])
    return words, np.cumsum(new), spans.doc


def ordered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words with a space behind, in byte order, and the rank (from 1) of each word among them.

    No word holds a space, so ranks compare word lists as their bytes compare when joined by spaces."""
    encoded = words.dictionary_encode()
    keys = pc.binary_join_element_wise(encoded.dictionary, pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary()))
    order = pc.sort_indices(keys).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return keys.take(pa.array(order)), rank[encoded.indices.to_numpy()]


class Leaves:
    """Sorted distinct leaves of one shard: language, ranks of four words (0: none) and counts."""

    def __init__(self, words: pa.Array, piece: np.ndarray, lang: np.ndarray, names: list[bytes]):
        self.names, self.keys = names, None
        self.keys, rank = ordered(words)
        base = len(self.keys) + 1
        code = lang.astype(np.int64) * base + rank
        seen, code = np.unique(code, return_inverse=True)  # ranks of (language, word), from 1
        code += 1
        n = len(code)
        after = np.zeros(n, np.int64)
        after[:-1] = np.where(piece[1:] == piece[:-1], code[1:], 0)
        bigrams, at = np.unique(code << 32 | after, return_inverse=True)
        rest = np.zeros(n, np.int64)
        rest[:-2] = np.where(piece[2:] == piece[:-2], at[2:] + 1, 0)
        leaf, self.count = np.unique(at << 32 | rest, return_counts=True)
        low = (1 << 32) - 1
        pairs, seen = np.append(0, bigrams), np.append(0, seen)
        first, second = pairs[(leaf >> 32) + 1], pairs[leaf & low]
        four = [seen[x] for x in (first >> 32, first & low, second >> 32, second & low)]
        self.lang, self.ranks = four[0] // base, [x % base for x in four]
        self.listed: list[bytes] | None = None

    def key(self, i: int) -> tuple[bytes, bytes]:
        if self.listed is None:
            self.listed = [b"", *self.keys.to_pylist()]
        return self.names[self.lang[i]], b"".join(self.listed[r[i]] for r in self.ranks)

    def cut(self, cuts: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, int, int, int]]:
        """Range, language and leaves (from, to) of every block: cut at the ranges and at the languages."""
        n = len(self.count)
        at = [bisect_left(range(n), c, key=self.key) for c in cuts]
        langs = np.flatnonzero(np.diff(self.lang)) + 1
        edges = np.unique(np.concatenate([[0, n], at, langs])).astype(int).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            yield int(np.searchsorted(at, a, "right")), int(self.lang[a]), a, b

    def block(self, a: int, b: int) -> tuple[int, int, int, bytes]:
        """Leaves, words, bytes of words and the serialised block: its words in order, then the four columns of local numbers, then counts."""
        ranks = np.concatenate([r[a:b] for r in self.ranks])
        used = np.unique(ranks)
        used = used[used > 0]
        words = pa.concat_arrays([self.keys.take(pa.array(used - 1))])
        offsets = np.frombuffer(words.buffers()[1], np.int32)
        spelt = words.buffers()[2].to_pybytes()[offsets[words.offset] : offsets[words.offset + len(words)]]
        local = np.zeros(len(self.keys) + 1, np.uint32)
        local[used] = np.arange(1, len(used) + 1)
        columns = local[ranks].astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
        payload = spelt + columns.tobytes() + self.count[a:b].astype(np.int64).tobytes()
        return b - a, len(used), len(spelt), zstandard.ZstdCompressor(level=1).compress(payload)


def opened(leaves: int, words: int, spelt: int, payload: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words (with a space behind), local numbers (4 x leaves) and counts of a serialised block."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    offsets = np.append(0, np.flatnonzero(data[:spelt] == 0x20) + 1).astype(np.int32)
    keys = pa.Array.from_buffers(pa.binary(), words, [None, pa.py_buffer(offsets), pa.py_buffer(data[:spelt].copy())])
    kind = np.uint16 if words < 1 << 16 else np.uint32
    middle = spelt + 4 * leaves * np.dtype(kind).itemsize
    columns = data[spelt:middle].copy().view(kind).reshape(4, leaves)
    return keys, columns, data[middle:].copy().view(np.int64)


BLOCK = "range int, lang string, leaves int, words int, spelt int, payload binary"


def _blocks(cuts, p: Phrases):
    """Function for ``mapInArrow``: tries of shards of texts (text, lang) as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        names: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            order = sorted(names, key=str.encode)
            place = np.empty(len(names), np.int64)
            place[[names[x] for x in order]] = np.arange(len(order))
            leaves = Leaves(pa.concat_arrays([w for w, _, _ in held]), np.concatenate([x for _, x, _ in held]), place[np.concatenate([x for _, _, x in held])], [x.encode() for x in order])
            rows, pending = [], 0
            for r, lang, a, b in leaves.cut(cuts.value):
                rows.append((r, order[lang], *leaves.block(a, b)))
                pending += len(rows[-1][-1])
                if pending > tk.PIECE * 8:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
                    rows, pending = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

        pieces = 0
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, texts in tk.pieces(batch.column(0)):
                words, piece, doc = words_of(texts)
                if not len(words):
                    continue
                codes = np.array([names.setdefault(x, len(names)) for x in langs[i : i + texts.n]], np.int64)
                held.append((words, piece + pieces, codes[doc]))
                pieces += int(piece[-1])
                size += len(words)
                if size >= p.shard_tokens:
                    yield from flush()
                    held, size, names = [], 0, {}
        if held:
            yield from flush()

    return run


_TYPES = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
_NAMES = ("range", "lang", "leaves", "words", "spelt", "payload")


def merged(blocks: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words in order, ranks (4 x leaves) and counts of the sorted distinct leaves of some sorted blocks.

    The sorts are stable and take the blocks as the runs that they are."""
    keys, rank = ordered(pa.concat_arrays([pc.binary_slice(k, 0, -1) for k, _, _ in blocks]))
    parts, at = [], 0
    for k, columns, _ in blocks:
        mine = np.append(0, rank[at : at + len(k)])
        at += len(k)
        parts.append(mine[columns])
    ranks, count = np.concatenate(parts, axis=1), np.concatenate([c for _, _, c in blocks])
    high, low = ranks[0] << 32 | ranks[1], ranks[2] << 32 | ranks[3]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.ones(len(order), bool)
    first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(first)
    return keys, ranks[:, order[at]], np.add.reduceat(count[order], at)


def nodes(keys: pa.Array, ranks: np.ndarray, count: np.ndarray, least: int) -> Iterator[tuple[int, pa.Array, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Depth, phrases, counts, counts of the prefixes by length, and whether other ranges may have more, of the nodes of a walk.

    Nodes have ``least`` occurrences here, or are on the path of the first or the last leaf."""
    spelt = pc.binary_slice(keys, 0, -1)
    new = np.zeros(len(count), bool)
    new[0] = True
    begins, sums = [], []
    for d in range(DEPTH):
        new = new.copy()
        new[1:] |= ranks[d, 1:] != ranks[d, :-1]
        begin = np.flatnonzero(new)
        total = np.add.reduceat(count, begin)
        begins.append(begin)
        sums.append(total)
        cut = np.zeros(len(begin), bool)
        cut[[0, -1]] = True
        kept = np.flatnonzero((ranks[d, begin] > 0) & ((total >= least) | cut))
        lefts = [sums[k][np.searchsorted(begins[k], begin[kept], "right") - 1] for k in range(d)]
        words = [spelt.take(pa.array(ranks[k, begin[kept]] - 1)) for k in range(d + 1)]
        phrases = words[0] if d == 0 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary()))
        yield d + 1, phrases, total[kept], lefts, cut[kept]


NODE = "lang string, depth int, phrase string, count bigint, l1 bigint, l2 bigint, l3 bigint, cut boolean"
_NODE = pa.schema([("lang", pa.string()), ("depth", pa.int32()), ("phrase", pa.string()), ("count", pa.int64()), ("l1", pa.int64()), ("l2", pa.int64()), ("l3", pa.int64()), ("cut", pa.bool_())])


def _merge(p: Phrases):
    """Function for ``applyInArrow``: the nodes of one range and language."""

    def run(blocks: pa.Table) -> pa.Table:
        lang = blocks.column("lang")[0].as_py()
        rows = zip(*(blocks.column(c).to_pylist() for c in ("leaves", "words", "spelt", "payload")), strict=True)
        keys, ranks, count = merged([opened(*row) for row in rows])
        out = [pa.table([[lang], [0], [""], [int(count.sum())], [None], [None], [None], [True]], schema=_NODE)]
        for depth, phrases, counts, lefts, cut in nodes(keys, ranks, count, p.least):
            n = len(counts)
            more = [pa.array(x) for x in lefts] + [pa.nulls(n, pa.int64())] * (3 - len(lefts))
            out.append(pa.table([pa.array([lang] * n, pa.string()), pa.array(np.full(n, depth, np.int32)), phrases.cast(pa.string(), safe=False), pa.array(counts), *more, pa.array(cut)], schema=_NODE))
        return pa.concat_tables(out)

    return run


def _cuts(texts: DataFrame, p: Phrases) -> list[tuple[bytes, bytes]]:
    """Where ranges begin, but for the first: language and words, from a sample of windows of bounded size."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = min(-(-size // p.range_bytes), p.most_ranges)
    if ranges < 2:
        return []

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, texts in tk.pieces(batch.column(0)):
                words, piece, doc = words_of(texts)
                rows = []
                for at in range(len(words) % p.stride, len(words), p.stride):
                    own = words.slice(at, int((piece[at : at + DEPTH] == piece[at]).sum())).to_pylist()
                    rows.append((langs[i + doc[at]].encode(), b"".join(w + b" " for w in own)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names=["lang", "words"])

    wanted = ranges * p.sampled
    share = wanted * p.stride / max(size / 8, 1)
    found: set[tuple[bytes, bytes]] = set()
    for share in (share, 1.0):  # a few long texts may all be missed
        some = texts if share >= 1 else texts.sample(share, seed=13)
        rows = some.mapInArrow(windows, "lang binary, words binary").limit(8 * wanted).toArrow()
        found = set(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
        if len(found) >= ranges:
            break
    order = sorted(found)
    return sorted({order[i * len(order) // ranges] for i in range(1, ranges)}) if order else []


def _bounded(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def frequent(documents: DataFrame, p: Phrases = Phrases()) -> tuple[DataFrame, DataFrame]:
    """lang, depth, phrase, count, lefts (of the first 1, 2, .. words) of every phrase of one to four words with ``least`` occurrences; and lang, n of all words."""
    small_batches(documents.sparkSession)
    texts = documents.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    cuts = documents.sparkSession.sparkContext.broadcast(_cuts(texts, p))  # bounded by most_ranges
    blocks = texts.mapInArrow(_blocks(cuts, p), BLOCK)
    found = written(blocks.groupBy("range", "lang").applyInArrow(_merge(p), NODE), "phrase-nodes")
    totals = written(found.where("cut").groupBy("lang", "depth", "phrase").agg(F.sum("count").alias("count")), "phrase-cuts")
    none = F.lit(None).cast("long")
    every = found.where("NOT cut").drop("cut").unionByName(totals.where(F.col("depth") > 0).withColumns({f"l{k}": none for k in (1, 2, 3)})).where(F.col("count") >= p.least)
    for k in (1, 2, 3):  # ancestors that go on in other ranges
        whole = totals.where(F.col("depth") == k).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_prefix"), F.col("count").alias("_whole"))
        here = (F.col("lang") == F.col("_lang")) & (F.substring_index("phrase", " ", k) == F.col("_prefix")) & (F.col("depth") > k)
        every = every.join(_bounded(whole, p.most_sent), here, "left").withColumn(f"l{k}", F.coalesce("_whole", f"l{k}")).drop("_lang", "_prefix", "_whole")
    lefts = F.slice(F.array("l1", "l2", "l3"), F.lit(1), F.col("depth") - 1)
    return written(every.select("lang", "depth", "phrase", "count", lefts.alias("lefts")), "phrases"), totals.where(F.col("depth") == 0).select("lang", F.col("count").alias("n"))


def linked(phrases: DataFrame) -> DataFrame:
    """``phrases`` of two words and more with rights: the counts of what is left without the first 1, 2, .. words, along the suffix links."""
    level = phrases.where(F.col("depth") == 1).withColumn("rights", F.array().cast("array<bigint>"))
    out = []
    for d in range(2, DEPTH + 1):
        shorter = level.select(F.col("lang"), F.col("phrase").alias("rest"), F.concat(F.array("count"), "rights").alias("rights"))
        rest = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
        level = phrases.where(F.col("depth") == d).withColumn("rest", rest).join(shorter, ["lang", "rest"]).drop("rest")
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def best_cut(scale: int) -> Column:
    """score, k, l and r of the lowest-scoring cut of a phrase, the least k of equal ones; decimals hold what passes 64 bits."""
    wide = lambda x: f"CAST({x} AS DECIMAL(20,0))"
    score = f"CAST({scale} AS DECIMAL(10,0)) * {wide('count')} div ({wide('lefts[k - 1]')} + {wide('rights[k - 1]')})"
    return F.expr(f"array_min(transform(sequence(1, depth - 1), k -> named_struct('score', {score}, 'k', k, 'l', lefts[k - 1], 'r', rights[k - 1])))")


def collocations(documents: DataFrame, p: Phrases = Phrases()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language."""
    phrases, words = frequent(documents, p)
    candidates = written(linked(phrases).select("lang", "depth", "phrase", F.col("count").alias("a"), best_cut(p.scale).alias("best")), "phrase-candidates")
    inner = F.expr("flatten(transform(sequence(2, depth - 1), m -> transform(sequence(1, depth - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    longer = candidates.where(F.col("depth") > 2).select("lang", "a", "depth", F.split("phrase", " ").alias("w")).select("lang", F.col("a").alias("over"), F.explode(inner).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    exact = lambda c, k: F.col(c).cast("decimal(20,0)") * F.lit(k).cast("decimal(4,0)")
    free = candidates.join(covered, ["lang", "phrase"], "left").where(F.col("over").isNull() | (exact("over", 100) < exact("a", p.covered_percent)))
    order = W.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    first = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.top)
    return first.join(_bounded(words, p.most_sent), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score")
    )


def op13_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: collocations(table(spark, sf_dir, "documents").select("text", "lang")), "collocations")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[s + 1 : s + k], ' ') AS phrase, lang || chr(9) || phrase AS key, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(len(w) - k + 1)) AS s FROM w, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k) GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS x FROM g WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, a, j, lang || chr(9) || array_to_string(x[1 : j], ' ') AS lp, lang || chr(9) || array_to_string(x[j + 1 : k], ' ') AS rp FROM c, (VALUES (1), (2), (3)) AS t(j) WHERE j < k),
scored AS (SELECT q.lang, q.phrase, a, j, gl.f AS l, gr.f AS r, ((2000000::HUGEINT * a) // (gl.f + gr.f))::BIGINT AS score
  FROM cuts q JOIN g gl ON gl.key = lp JOIN g gr ON gr.key = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
covered AS (SELECT lang, array_to_string(x[s + 1 : s + m], ' ') AS phrase, max(a) AS over
  FROM (SELECT lang, x, a, m, unnest(range(k - m + 1)) AS s FROM c, (VALUES (2), (3)) AS t(m) WHERE m < k) GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best b LEFT JOIN covered USING (lang, phrase) WHERE over IS NULL OR 100::HUGEINT * over < 80::HUGEINT * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
