"""Scalar text functions as column expressions.

Patterns are written so that Java, RE2 and Python agree on them: no word
boundaries next to letters beyond ASCII, no ``\\w``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Number-preserving tokens: letters and digits, with decimals and thousands kept whole.
TOKEN = r"[\p{L}\p{N}]+(?:[.,][0-9]+)*"
#: Fixed value: tokens of the answer metrics.
METRIC_TOKEN = r"[a-z0-9$%.]+"
ZERO_WIDTH = "[­​‌‍⁠﻿]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0))


def metric_tokens(c: Column | str) -> Column:
    """Lower-case tokens with decimals; full stops at the end go."""
    raw = F.regexp_extract_all(squash(c), F.lit(METRIC_TOKEN), F.lit(0))
    return F.filter(F.transform(raw, lambda t: F.regexp_replace(t, r"\.+$", "")), lambda t: t != "")


def squash(c: Column | str) -> Column:
    """Lower case, white space collapsed, stripped; null becomes empty."""
    return strip(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\s+", " "))


def word_count(c: Column | str) -> Column:
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+")))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no expression for it."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def tidy(c: Column | str) -> Column:
    """Everything of ``normalize`` but the compatibility composition, inside Catalyst.

    One line feed for any line end, no invisible or control characters, words
    joined over hyphenated line ends, lines stripped, empty lines dropped, blanks collapsed."""
    t = F.regexp_replace(F.regexp_replace(col(c), r"\r\n", "\n"), "\r", "\n")
    t = F.regexp_replace(F.regexp_replace(t, ZERO_WIDTH, ""), CONTROL, "")
    t = F.regexp_replace(t, r"(?<=[A-Za-z])-\n(?=[a-z])", "")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: strip(x)), lambda x: x != "")
    return F.coalesce(F.regexp_replace(F.array_join(lines, "\n"), r"[ \t]+", " "), F.lit(""))


def normalize(c: Column | str) -> Column:
    return tidy(nfkc(F.regexp_replace(F.regexp_replace(col(c), r"\r\n", "\n"), "\r", "\n")))


def strip_markdown(c: Column | str, italic: bool = True) -> Column:
    """Markdown syntax removed in a fixed order; a dash before a digit and underscores stay."""
    t = F.coalesce(col(c), F.lit(""))
    for pattern, to in MARKDOWN:
        if italic or pattern != ITALIC:
            t = F.regexp_replace(t, pattern, to)
    return t


ITALIC = r"(?<!\*)\*([^*\n]+)\*(?!\*)"
#: The order matters.
MARKDOWN = (
    (r"(?m)^[ \t]*```.*$", ""),
    (r"`([^`\n]+)`", "$1"),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""),
    (r"(?m)^[ \t]{0,3}[-*+][ \t]+(\D)", "$1"),
    (r"(?m)^[ \t]*[-*_]{3,}[ \t]*$", ""),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (ITALIC, "$1"),
    (r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$", ""),
    (r"(?m)^[ \t]*\|[ \t]*(.*?)[ \t]*\|[ \t]*$", "$1"),
)


def alnum_ratio(c: Column | str) -> Column:
    """Share of letters and digits among what is not white space; null for nothing but white space."""
    solid = F.length(F.regexp_replace(col(c), r"\s", ""))
    return F.length(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", "")) / F.when(solid > 0, solid)


def is_gibberish(clean: Column | str, least_ratio: float = 0.5, least_chars: int = 100) -> Column:
    """Symbols rather than prose; short texts are not judged."""
    return (F.length(col(clean)) >= least_chars) & F.coalesce(alnum_ratio(clean) < least_ratio, F.lit(True))


def claims(c: Column | str) -> Column:
    """Sentences of an answer; decimals stay whole."""
    parts = F.split(F.regexp_replace(F.coalesce(col(c), F.lit("")), "\n", " "), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p != "")


def nli_claims(c: Column | str, least_words: int = 2) -> Column:
    """Sentences and lines of an answer that have at least two words."""
    parts = F.split(F.coalesce(col(c), F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda p: strip(p)), lambda p: (p != "") & (F.size(F.split(p, r"\s+")) >= least_words))


def ellipsis(c: Column | str, most: int) -> Column:
    t = F.coalesce(col(c), F.lit(""))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, max(0, most - 1)), r"\s+$", ""), F.lit("…")))


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.replace(col(c), F.lit("\\"), F.lit("/")), "/+$", ""), "/"), -1)


def stem(c: Column | str) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


#: Fixed value: a reference to a page.
CITATION = r"(?i)\(([^()]+?),\s*(?:p\.?|page)\s*([0-9]+)\)"


def citations(c: Column | str) -> Column:
    """array<struct<document, page>> of "(name, p.2)" references, names as lower-case base names."""
    names = F.regexp_extract_all(col(c), F.lit(CITATION), F.lit(1))
    page = F.regexp_extract_all(col(c), F.lit(CITATION), F.lit(2))
    pair = lambda n, p: F.struct(F.lower(strip(basename(n))).alias("document"), p.cast("int").alias("page"))
    return F.zip_with(names, page, pair)


def list_lines(c: Column | str, original: Column | str, most: int) -> Column:
    """Alternatives from a model's list: one per line, bullets, numbers and quotes off, repeats
    (of the original question too) dropped by their squashed form, the first ``most`` kept."""
    lines = F.transform(F.split(F.regexp_replace(col(c), r"\r\n?", "\n"), "\n"), lambda x: strip(F.regexp_replace(x, r"^\s*(?:[-*+\x{2022}]\s*|[0-9]+\.\s*)?", "")))
    lines = F.transform(lines, lambda x: strip(F.regexp_replace(strip(F.regexp_replace(x, r'^"+|"+$', "")), r"^'+|'+$", "")))
    lines = F.filter(lines, lambda x: (x != "") & (squash(x) != squash(original)))
    first = F.filter(lines, lambda x, i: F.array_position(F.transform(lines, lambda y: squash(y)), squash(x)) == i + 1)
    return F.slice(first, 1, most)


def softmax(a: Column | str) -> Column:
    e = F.transform(col(a), lambda x: F.exp(x.cast("double") - F.array_max(col(a)).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def dot(a: Column | str, b: Column | str) -> Column:
    product = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a side is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def _dihedral() -> list[int]:
    """Multiplication table of the dihedral group of order ten, row by row."""
    def times(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
        return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5

    return [times(a, b) for a in range(10) for b in range(10)]


def _permutations() -> list[int]:
    """Powers 0 to 7 of the check's permutation, row by row."""
    once = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([once[x] for x in rows[-1]])
    return [x for row in rows for x in row]


DIHEDRAL, PERMUTATIONS = _dihedral(), _permutations()


def verhoeff(digits: Column | str) -> Column:
    """True if the digit string's Verhoeff check is right; false for anything but digits."""
    d, p = F.array(*map(F.lit, DIHEDRAL)), F.array(*map(F.lit, PERMUTATIONS))
    numbers = F.transform(F.split(F.reverse(col(digits)), ""), lambda x, i: F.struct(F.try_to_number(x, F.lit("9")).cast("int").alias("v"), i.alias("i")))
    check = F.aggregate(numbers, F.lit(0), lambda c, x: F.get(d, c * 10 + F.get(p, (x["i"] % 8) * 10 + x["v"])))
    return col(digits).rlike("^[0-9]+$") & (F.coalesce(check, F.lit(-1)) == 0)


def choice(c: Column | str, choices: Column | str) -> Column:
    """Index (from 0) of the choice that an answer names: a lone capital letter, else a choice's whole text; null if neither."""
    letter = F.regexp_extract(col(c), r"(?:^|[^A-Za-z])([A-Z])(?:[^A-Za-z]|$)", 1)
    at = F.when(letter != "", F.ascii(letter) - F.ascii(F.lit("A")))
    text = F.array_position(F.transform(col(choices), lambda x: squash(x)), squash(c)) - 1
    return F.when((at >= 0) & (at < F.size(col(choices))), at).when(text >= 0, text.cast("int"))


def choice_prompt(question: Column | str, choices: Column | str) -> Column:
    """A multiple-choice question with lettered options."""
    line = F.transform(col(choices), lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x))
    return F.concat(F.lit("Question: "), col(question), F.lit("\n\nOptions:\n"), F.array_join(line, "\n"), F.lit("\n\nReply with only the letter of the single best answer."))


def coerced(c: Column, kind: str) -> Column:
    """A metadata value as a number, a string, or a list of strings; ``kind`` is its simple type."""
    if kind == "boolean":
        return c.cast("int")
    if kind.startswith("array"):
        return F.transform(c, lambda x: x.cast("string"))
    plain = kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "string")
    return c if plain else (F.to_json(c) if kind.startswith(("struct", "map")) else c.cast("string"))


def looks_tabular(c: Column | str) -> Column:
    """At least half of the lines, and two, have three cells or more between wide gaps."""
    lines = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "\n"), lambda x: strip(x)), lambda x: x != "")
    wide = F.size(F.filter(lines, lambda x: F.size(F.split(x, r"\s{2,}")) >= 3))
    return (F.size(lines) >= 2) & (wide >= F.greatest(F.lit(2.0), F.bround(F.size(lines) * 0.5)))


def context_header(title: Column | str, filename: Column | str, page: Column | str) -> Column:
    """"title · page n"; the file's stem where there is no title."""
    name = F.coalesce(F.nullif(strip(title), F.lit("")), stem(filename), F.lit(""))
    return F.concat_ws(" · ", F.nullif(strip(name), F.lit("")), F.concat(F.lit("page "), col(page).cast("string")))


def chunk_key(clean: Column | str) -> Column:
    return F.sha2(F.lower(col(clean)), 256)
