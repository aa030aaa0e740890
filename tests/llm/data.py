"""Small tables with the awkward cases: nulls, empties, ties, repeats, long texts, extra columns."""

from __future__ import annotations

import random

SYLLABLES = ("an", "the", "er", "st", "ing", "ou", "re", "ti", "ly", "ha")


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(words))


def documents(spark, rows, extra: bool = False):
    """Rows of (doc_id, text[, lang[, source]]) as a table of documents; ``extra`` adds columns with names used inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for name in ("key", "node", "size", "rank", "score", "spans", "rid", "component", "kept", "unit", "label", "shard", "_nth", "host", "target"):
            df = df.withColumn(name, F.lit("x"))
    return df


def odd_rows():
    long = prose(5, 60_000)
    base = prose(1, 120)
    near = base.split()
    near[50] = "changed"
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), None, "b"), (4, None, None, None), (5, "", "", ""), (6, " \n\t ", "en", "b"), (7, "word", "fr", "b"),
        (8, "two words", None, "c"), (8, "two words", None, "c"), (9, long, "en", "a"), (10, "漢字 かな 한글 Ünï �", "zz", "a"), (None, prose(9, 80), "en", "a"), (11, prose(11, 200), "de", "b"),
    ]
