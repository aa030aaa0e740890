"""Quality rules: plain counts, then tokeniser fertility against bands per language or script.

Two public vocabularies measure each text: characters per token of a byte-level
vocabulary, and byte-fallback share and token entropy of a vocabulary with byte
fallback.  The measures of the whole corpus give each language (or script, where
no language is named) its quartiles, from exact histograms; a document is
rejected when a measure is outside its group's outer fences.  Every group, however
small, has fences around its own quartiles; how far they reach is shrunk towards
the spread of all documents, smoothly with the group's size.

One pass over the texts (numpy over whole Arrow batches, each distinct word
tokenised once per worker) writes a row of numbers per document; everything
after works on those.

Edge cases: null or empty text, or text without words, has zero counts and null
measures and fails the base rule; repeated rows are judged alike; a null or empty
lang falls back to the script of the letters (``und`` without letters); an empty
table gives no rows; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkernel as tk
from .shared import small_batches, table, written
from .wordtokens import WordTokens, byte_ids, encoder, listed

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Fertility:
    """Parameters of the method."""

    byte_level: str = "byte_bpe_50k.tiktoken"
    byte_fallback: str = "piece_bpe_32k.model"
    folder: str | None = None  # of the vocabularies, where not the installed ones
    least_words: int = 50
    most_repeat_percent: int = 50
    fence: float = 3.0  # quartile distances beyond the quartiles
    least_spread: tuple[float, float, float] = (0.15, 0.01, 0.25)  # at least this quartile distance
    prior_documents: int = 20  # a group's quartile distance counts as its documents, that of all documents as so many
    broadcast_bands: int = 100_000  # fences of up to so many bands are broadcast
    bins: tuple[float, float, float] = (0.01, 0.001, 0.01)  # histogram bins of the measures


MEASURES = ("chars_per_token", "byte_share", "entropy")

#: Scripts and the first code point of each range of theirs; a range ends where the next one begins.
SCRIPT_RANGES = (
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00C0, "latin"), (0x0250, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"), (0x0800, ""), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "canadian"), (0x1680, ""), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C60, "latin"), (0x2C80, "coptic"), (0x2D00, "georgian"), (0x2D30, "tifinagh"), (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"), (0x2E00, ""),
    (0x3040, "kana_han"), (0x3130, "hangul"), (0x3190, "kana_han"), (0xA000, "yi"), (0xA4D0, ""), (0xA640, "cyrillic"), (0xA6A0, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "kana_han"), (0xFB00, "latin"),
    (0xFB13, ""), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFEFF, ""), (0xFF21, "latin"), (0xFF3B, ""), (0xFF41, "latin"), (0xFF5B, ""), (0xFF66, "kana_han"), (0xFFA0, "hangul"),
    (0xFFDD, ""), (0x10000, "beyond"), (0x20000, "kana_han"), (0x323B0, "beyond"),
)
_SCRIPTS = sorted({name for _, name in SCRIPT_RANGES} - {""})
_RANGE_STARTS = np.array([start for start, _ in SCRIPT_RANGES])
_RANGE_SCRIPT = np.array([_SCRIPTS.index(name) if name else -1 for _, name in SCRIPT_RANGES])


def code_points(texts: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all characters, and the byte where each begins."""
    data = texts.data
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int64)
    more = (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    code = np.where(more == 0, lead, lead & (0x3F >> more))
    for k in (1, 2, 3):
        longer = np.flatnonzero(more >= k)
        code[longer] = (code[longer] << 6) | (data[np.minimum(at[longer] + k, len(data) - 1)] & 0x3F)
    return code, at


def scripts_of(texts: tk.Texts) -> np.ndarray:
    """The script of most letters of each text; the first by name among equals, und without letters."""
    code, at = code_points(texts)
    script = _RANGE_SCRIPT[np.searchsorted(_RANGE_STARTS, code, "right") - 1]
    some = np.flatnonzero(script >= 0)
    width = len(_SCRIPTS)
    n = np.bincount(texts.doc_of(at[some]) * width + script[some], minlength=texts.n * width).reshape(texts.n, width)
    return np.where(n.sum(1) > 0, np.array(_SCRIPTS)[n.argmax(1)], "und")


def base_counts(texts: tk.Texts) -> tuple[tk.Spans, np.ndarray, dict[str, np.ndarray]]:
    """Words, their hashes, and the plain counts of each document."""
    n, data = texts.n, texts.data
    w = texts.words()
    h = texts.hashes(w)
    head = (data & 0xC0) != 0x80  # first bytes of characters
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    lines = texts.lines()
    worded = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    lh, ld = texts.hashes(lines)[worded], lines.doc[worded]
    once = np.bincount(tk.distinct(lh, ld)[1], minlength=n)
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        same = np.flatnonzero(w.doc[:-2] == w.doc[2:])
        g, d = tk.grams(h, w.doc, 3)
        key = tk.mix(g + d.astype(tk.U) * tk.U(0xD6E8FEB86659FD93))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = same[count[inverse] > 1]
        for k in range(3):
            covered[twice + k] = True
    counts = {
        "n_words": np.bincount(w.doc, minlength=n),
        "word_chars": texts.count(head & ~tk.SPACE[data]),
        "n_symbols": texts.count(symbol[data]),
        "n_dup_lines": np.bincount(ld, minlength=n) - once,
        "n_repeat_words": np.bincount(w.doc[covered], minlength=n),
    }
    return w, h, counts


def _entropy(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Shannon entropy in bits of each document's tokens."""
    key = np.sort((doc << 32) | ids)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    total = np.bincount(doc, minlength=n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log2(total) - np.bincount(key[at] >> 32, count * np.log2(count), minlength=n) / total


def measure(documents: DataFrame, p: Fertility, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, base counts and measures of every document, with its band group."""
    m = len(keep)

    def rows_of(texts: tk.Texts, plain: WordTokens, fallback: WordTokens, is_byte: np.ndarray) -> tuple[dict[str, np.ndarray], tuple, np.ndarray]:
        """Counts, measures and script of each text."""
        w, h, counts = base_counts(texts)
        n = texts.n
        _, per_word = plain.tokens(texts, w, h)
        plain_tokens = np.bincount(w.doc, per_word, minlength=n)
        ids, per_word = fallback.tokens(texts, w, h)
        doc = np.repeat(w.doc, per_word)
        tokens = np.bincount(doc, minlength=n)
        with np.errstate(divide="ignore", invalid="ignore"):
            measures = (counts["word_chars"] / plain_tokens, np.bincount(doc[is_byte[ids]], minlength=n) / tokens, _entropy(ids, doc, n))
        return counts, measures, scripts_of(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_byte = byte_ids(p.byte_fallback, p.folder)
        with WordTokens(listed(encoder(p.byte_level, p.folder, lead=" "))) as plain, WordTokens(listed(encoder(p.byte_fallback, p.folder))) as fallback:
            for batch in batches:
                for i, texts in tk.pieces(batch.column(m)):
                    counts, measures, named = rows_of(texts, plain, fallback, is_byte)
                    n, none = texts.n, counts["n_words"] == 0
                    lang = batch.column(m + 1).slice(i, n).to_pylist()
                    group = [f"lang:{a}" if a else f"script:{b}" for a, b in zip(lang, named.tolist(), strict=True)]
                    columns = [*(c.slice(i, n) for c in batch.columns[:m]), pa.array(group, pa.string()), *(pa.array(c, pa.int64()) for c in counts.values())]
                    columns += [pa.array(np.nan_to_num(x).round(6), pa.float64(), mask=none) for x in measures]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, "band", *counts, *MEASURES])

    kinds = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    more = StructType.fromDDL(f"band string, {kinds}, " + ", ".join(f"{x} double" for x in MEASURES))
    return documents.select(*keep, "text", "lang").mapInArrow(run, StructType([*documents.select(*keep).schema, *more]))


def base_failed(p: Fertility) -> Column:
    return (F.col("n_words") < p.least_words) | (100 * F.col("n_repeat_words") > p.most_repeat_percent * F.col("n_words"))


def fences(measured: DataFrame, p: Fertility) -> DataFrame:
    """band, and low and high fence of each measure, from quartiles over all documents that pass the base rule.

    A band has its own quartiles at any size; its quartile distance is shrunk
    towards that of all documents (the band ``*``), the more the fewer it has."""
    passed = measured.where(~base_failed(p))
    bins = [F.floor(F.col(m) / b).alias(m) for m, b in zip(MEASURES, p.bins, strict=True)]
    long = passed.select("band", F.posexplode(F.array(*bins)).alias("measure", "bin")).groupBy("band", "measure", "bin").agg(F.count("*").alias("n"))
    long = long.unionByName(long.groupBy(F.lit("*").alias("band"), "measure", "bin").agg(F.sum("n").alias("n")))
    upto = F.sum("n").over(W.partitionBy("band", "measure").orderBy("bin"))
    total = F.sum("n").over(W.partitionBy("band", "measure"))
    q = long.withColumn("_upto", upto).withColumn("_total", total).groupBy("band", "measure")
    quartile = lambda share: F.min(F.when(F.col("_upto") >= share * F.col("_total"), F.col("bin")))
    q = q.agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.max("_total").alias("documents"))
    width = F.element_at(F.array(*map(F.lit, p.bins)), F.col("measure") + 1)
    least = F.element_at(F.array(*map(F.lit, p.least_spread)), F.col("measure") + 1)
    pick = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(side)))
    q = q.select("band", "documents", "measure", (F.col("q1") * width).alias("_q1"), ((F.col("q3") + 1) * width).alias("_q3"), least.alias("_least"))
    q = written(q, "quartiles")
    whole = q.where("band = '*'").select("measure", (F.col("_q3") - F.col("_q1")).alias("_whole"))
    n, k = F.col("documents"), F.lit(p.prior_documents)
    spread = (n * (F.col("_q3") - F.col("_q1")) + k * F.col("_whole")) / (n + k)
    reach = p.fence * F.greatest(spread, F.col("_least"))
    q = q.join(F.broadcast(whole), "measure").select("band", "documents", "measure", (F.col("_q1") - reach).alias("low"), (F.col("_q3") + reach).alias("high"))
    return q.groupBy("band").agg(F.max("documents").alias("documents"), *(pick(m, s).alias(f"{s}_{m}") for m in range(3) for s in ("low", "high")))


def judged(measured: DataFrame, p: Fertility) -> DataFrame:
    """``measured`` with base_failed and kept.

    The fences are one row per language or script: broadcast while their count
    is within its bound, and joined by band beyond it."""
    f = written(fences(measured, p).where("band <> '*'").drop("documents"), "fences")
    out = measured.join(F.broadcast(f) if f.count() <= p.broadcast_bands else f, "band", "left")
    inside = F.lit(True)
    for m, name in enumerate(MEASURES):
        inside = inside & F.coalesce(F.col(name).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(True))
    return out.withColumn("base_failed", base_failed(p)).withColumn("kept", ~F.col("base_failed") & inside)


def judge(documents: DataFrame, p: Fertility = Fertility(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, counts, measures and verdict of every document."""
    small_batches(documents.sparkSession)
    out = judged(written(measure(documents, p, keep), "fertility"), p)
    return out.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "band", *MEASURES)


def accepted(documents: DataFrame, p: Fertility = Fertility()) -> DataFrame:
    """The rows of ``documents`` that are kept, whole; each row carries its own measures, so none meets another's."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.struct(*documents.columns).alias("__foliant_row"), "text", "lang")
    return judged(written(measure(rows, p, ("__foliant_row",)), "fertility-rows"), p).where("kept").select("__foliant_row.*")


def op3_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
