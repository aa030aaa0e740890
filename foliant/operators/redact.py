"""Finding and replacing personal data.

Recognisers are patterns with a base score, words that raise it when they stand
just before, and for some a checksum; a few redact only the value after a label.
Spans are found with offsets in one vectorised function; a span of a specific
kind inside a generic one wins, and what is left is replaced from the right.

Before text leaves the engine the functions fail closed: an error fails the task.
For display there is an open variant that passes the text through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from foliant.functions.text import DIHEDRAL, PERMUTATIONS, col
from foliant.operators.recognizers import GIVEN_NAMES, NAME_CUES, RECOGNIZERS

SPAN = StructType([StructField("entity", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())])
THRESHOLD = 0.4
CONTEXT_LIFT, CONTEXT_FLOOR, CONTEXT_WORDS = 0.35, 0.4, 5


@dataclass(frozen=True)
class Recognizer:
    entity: str
    pattern: str
    score: float
    context: tuple[str, ...] = ()
    group: int = 0  # the part that is redacted
    check: str | None = None
    generic: bool = False  # yields to a specific span inside it


def verhoeff_ok(digits: str) -> bool:
    """Verhoeff check of a digit string, by the tables that the column function has."""
    c = 0
    for i, ch in enumerate(reversed(digits)):
        c = DIHEDRAL[c * 10 + PERMUTATIONS[(i % 8) * 10 + int(ch)]]
    return c == 0


def luhn_ok(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return len(digits) >= 12 and sum(doubled) % 10 == 0


def iban_ok(text: str) -> bool:
    t = re.sub(r"\s", "", text).upper()
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


CHECKS: dict[str, Callable[[str], bool]] = {"verhoeff": lambda t: verhoeff_ok(re.sub(r"\D", "", t)), "luhn": luhn_ok, "iban": iban_ok}
_TABLE = tuple(Recognizer(*row) for row in RECOGNIZERS)
_COMPILED = tuple((r, re.compile(r.pattern, re.IGNORECASE | re.MULTILINE | re.DOTALL)) for r in _TABLE)
_GENERIC = {r.entity for r in _TABLE if r.generic} | {"PERSON"}

#: A person's name by its look: after a cue, or beginning with a common given name.
PERSON_SCORE = 0.85
_WORDS = r"[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?"
_INITIAL = r"(?:[ ][A-Z]\.)?"
_CUED = re.compile(rf"\b(?i:{'|'.join(map(re.escape, NAME_CUES))})\b[ ]*(?:[:,\-]|\bis\b)?\s*({_WORDS}{_INITIAL}(?:[ ]{_WORDS}){{1,2}})\b")
_GIVEN = re.compile(rf"\b((?:{'|'.join(GIVEN_NAMES)}){_INITIAL}(?:[ ]{_WORDS}){{1,2}})\b")


def names_in(text: str) -> list[tuple[int, int]]:
    """Names without an honorific; the default where no recogniser of names is given."""
    return sorted({m.span(1) for pattern in (_CUED, _GIVEN) for m in pattern.finditer(text)})


Persons = Callable[[str], list[tuple[int, int]]]


def find(text: str | None, threshold: float = THRESHOLD, persons: Persons = names_in) -> list[tuple[str, int, int, float]]:
    """Spans of one text, by start, without overlaps: the higher score wins, then the higher base score, then the longer.

    ``persons`` gives the spans of names: any recogniser, by default one by their look."""
    if not text:
        return []
    found: dict[tuple[str, int, int], tuple[float, float]] = {("PERSON", a, b): (PERSON_SCORE, PERSON_SCORE) for a, b in persons(text) if PERSON_SCORE >= threshold}
    for r, pattern in _COMPILED:
        for m in pattern.finditer(text):
            start, end = m.span(r.group)
            if end <= start:
                continue
            score = r.score
            if r.check is not None and CHECKS[r.check](m[r.group]):
                score = 1.0
            elif r.context and any(_near(w, text, start) for w in r.context):
                score = min(1.0, max(score + CONTEXT_LIFT, CONTEXT_FLOOR))
            if score >= threshold:
                found[(r.entity, start, end)] = max((score, r.score), found.get((r.entity, start, end), (0.0, 0.0)))
    spans = [(e, s, t, *p) for (e, s, t), p in found.items()]
    return _apart(_specific(spans))


def _specific(spans: list[tuple]) -> list[tuple]:
    """Without generic spans that hold a specific one: of the specific ones from a start on, the least end tells."""
    specific = sorted((x[1], x[2]) for x in spans if x[0] not in _GENERIC)
    starts, least = [a for a, _ in specific], [b for _, b in specific]
    for i in range(len(least) - 2, -1, -1):
        least[i] = min(least[i], least[i + 1])

    def holds(x: tuple) -> bool:
        i = bisect_left(starts, x[1])
        return i < len(least) and least[i] <= x[2]

    return [x for x in spans if x[0] not in _GENERIC or not holds(x)]


def _apart(spans: list[tuple]) -> list[tuple[str, int, int, float]]:
    """The best spans that don't overlap, by start: each is held against its neighbours only."""
    starts: list[int] = []
    chosen: list[tuple] = []
    for x in sorted(spans, key=lambda x: (-x[3], -x[4], x[1] - x[2], x[1], x[0])):
        i = bisect_left(starts, x[1])
        if (i == 0 or chosen[i - 1][2] <= x[1]) and (i == len(chosen) or x[2] <= chosen[i][1]):
            starts.insert(i, x[1])
            chosen.insert(i, x)
    return [x[:4] for x in chosen]


def _near(word: str, text: str, start: int) -> bool:
    before = " ".join(re.findall(r"[\w/']+", text[max(0, start - 80) : start].lower())[-CONTEXT_WORDS:])
    return re.search(rf"(?:^|\s){re.escape(word)}(?:$|\s)", before) is not None


def scrub(text: str | None, threshold: float = THRESHOLD, persons: Persons = names_in) -> str | None:
    """The text with every span as <ENTITY>."""
    if not text:
        return text
    return replaced(text, find(text, threshold, persons))


def replaced(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with ``spans``, in order and apart, as <ENTITY>."""
    out, at = [], 0
    for entity, start, end, _ in spans:
        out += [text[at:start], f"<{entity}>"]
        at = end
    return "".join([*out, text[at:]])


def matched(text: str | None) -> list[tuple[str, str]]:
    """Entity and redacted part of every match of every pattern, before scores, checks and overlaps."""
    return [(r.entity, m[r.group]) for r, pattern in _COMPILED for m in pattern.finditer(text or "") if m[r.group]]


@F.pandas_udf(ArrayType(StructType([StructField("entity", StringType()), StructField("part", StringType())])))
def candidates(s: pd.Series) -> pd.Series:
    """What the patterns alone find in every text, in the order of the table of patterns."""
    return s.map(lambda t: [{"entity": e, "part": p} for e, p in matched(t)])


#: Only texts with a digit of any script, an at sign or one of these words, in any case that Unicode knows, can hold anything
#: that the default recognisers find.  A character that Java doesn't know yet may be a digit.
_HINTS = (
    "mrs?", "ms", "dr", "shri", "smt", "prof", "[sdwc]/o", "streets?", "roads?", "lanes?", "avenues?", "colony", "nagar", "sector", "villas?", "towers?", "apartments?", "locality", "estate", "bhawan", "society",
    "layout", "chawl", "marg", "loan", "policy", "lic", "licen[cs]e", "endowment", "motor", "insurance", "application", "applicant", "customer", "proposal", "reference", "ref", "enquiry", "lead", "file",
)
HINT = rf"(?iu)[\p{{Nd}}\p{{Cn}}@]|(?:^|[^a-z0-9_])(?:{'|'.join((*_HINTS, *NAME_CUES, *GIVEN_NAMES))})(?:$|[^a-z0-9_])"


def may_hold(text: Column) -> Column:
    """False for texts that Catalyst can tell hold nothing to redact; they never go to Python."""
    return text.rlike(HINT)


@F.pandas_udf(ArrayType(SPAN))
def spans_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [{"entity": e, "start": a, "end": b, "score": p} for e, a, b, p in find(t)])


def detect(text: Column | str) -> Column:
    """Spans of every text; an error fails the task."""
    c = col(text)
    return spans_udf(F.when(may_hold(c), c))


def _scrubber(fail: Callable[[str, Exception], str | None] | None, persons: Persons) -> Callable[[Column], Column]:
    def one(t: str | None) -> str | None:
        try:
            return scrub(t, persons=persons)
        except Exception as error:  # noqa: BLE001  what then is the caller's rule
            if fail is None:
                raise
            return fail(t, error)

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run


scrub_udf = _scrubber(None, names_in)  # by itself, for SQL


def _redacted(text: Column | str, fail: Callable[[str, Exception], str | None] | None, persons: Persons) -> Column:
    c = col(text)
    mine = may_hold(c) if persons is names_in else F.lit(True)  # another recogniser may find names anywhere
    return F.when(mine, _scrubber(fail, persons)(F.when(mine, c))).otherwise(c)


def redact(text: Column | str, persons: Persons = names_in) -> Column:
    """Texts for what leaves the engine: an error fails the task."""
    return _redacted(text, None, persons)


def redact_for_display(text: Column | str, persons: Persons = names_in) -> Column:
    """Texts for display: a text that can't be scrubbed passes through."""
    return _redacted(text, lambda t, error: t, persons)


def redact_or_drop(text: Column | str, persons: Persons = names_in) -> Column:
    """Texts for memory: one that can't be scrubbed is dropped (null)."""
    return _redacted(text, lambda t, error: None, persons)


def redact_after(text: Column, carry: Column) -> Column:
    """Texts scrubbed with what stands before them in view: a label there counts for a value here, and only ``text`` is returned."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series, carries: pd.Series) -> pd.Series:
        return pd.Series([scrub_after(t, c) for t, c in zip(texts, carries, strict=True)])

    return run(text, carry)


def scrub_after(text: str | None, carry: str | None) -> str | None:
    if not text:
        return text
    whole, offset = (carry or "") + text, len(carry or "")
    out, at = [], offset
    for entity, start, end, _ in find(whole):
        if end > offset:
            out += [whole[at : max(start, offset)], f"<{entity}>"]
            at = end
    return "".join([*out, whole[at:]])


#: Fixed shapes that Catalyst can replace alone, in order; "$1" is what stands before.
FIXED = (
    ("EMAIL_ADDRESS", r"(^|[^A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("CREDIT_CARD", r"(^|[^0-9A-Za-z])[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}($|[^0-9A-Za-z])"),
    ("IP_ADDRESS", r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}($|[^0-9.])"),
    ("PAN_NUMBER", r"(^|[^0-9A-Za-z])[A-Z]{5}[0-9]{4}[A-Z]($|[^0-9A-Za-z])"),
)


def redact_fixed(text: Column) -> Column:
    """Fixed shapes replaced inside Catalyst."""
    for entity, pattern in FIXED:
        text = F.regexp_replace(text, pattern, f"$1<{entity}>" + ("$2" if pattern.count("(") > 1 else ""))
    return text


#: What must not stand in an answer.
LEAKS = (
    r"\b\d{3}[- .]?\d{2}[- .]?\d{4}\b",
    r"\b\d{4}[- .]?\d{4}[- .]?\d{4}[- .]?\d{4}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"\b(?:AADHAAR)?\d{12}\b",
    r"\b[A-Z]{5}\d{4}[A-Z]\b",
    r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\dZ[A-Z\d]\b",
    r"\b[A-Z]{3}\d{7}\b",
    r"\b[A-Z]{4}\d{4}[A-Z]\d\b",
    r"\b(?:a\s*/?\s*c|acc(?:ount)?|acct)\.?\s*(?:no\.?|number|num\.?)?\s*[:\-]?\s*\d{8,20}\b",
    r"\bloan\s*(?:a\s*/?\s*c|acc(?:ount)?|acct)\.?\s*(?:no\.?|number|num\.?)?\s*[:\-]?\s*\d{8,20}\b",
)


def leak_score(text: Column) -> Column:
    """Share of the leak patterns that an answer shows."""
    hits = sum((text.rlike("(?i)" + p).cast("int") for p in LEAKS), F.lit(0))
    return F.coalesce(hits / len(LEAKS), F.lit(0.0))


def unshadowed(spans: Column, generic: tuple[str, ...]) -> Column:
    """Spans without the generic ones that hold a specific span inside."""
    inside = lambda s, o: ~o["entity"].isin(*generic) & (s["start"] <= o["start"]) & (o["end"] <= s["end"])
    return F.filter(spans, lambda s: ~(s["entity"].isin(*generic) & F.exists(spans, lambda o: inside(s, o))))


def rebased(spans: Column, carried: Column) -> Column:
    """Spans of a text with a carried prefix, in terms of the text alone; what lies in the prefix goes."""
    kept = F.filter(spans, lambda s: s["end"] > carried)
    return F.transform(kept, lambda s: F.struct(s["entity"].alias("entity"), F.greatest(s["start"] - carried, F.lit(0)).alias("start"), (s["end"] - carried).alias("end"), s["score"].alias("score")))


def with_carry(ranked: DataFrame, group: str, order: str, text: str, chars: int = 80) -> DataFrame:
    """Adds carry: the end of the text before in the group, so that a label split from its value is seen."""
    before = F.lag(text).over(W.partitionBy(group).orderBy(order))
    return ranked.withColumn("carry", F.coalesce(F.right(before, F.lit(chars)), F.lit("")))
