"""Streaming operators with state, and their batch counterparts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.redact import find, replaced, scrub

TAIL = 120
BACK = 400  # characters of released text that stay in view


class StableScrubber:
    """Releases scrubbed text only up to where more text can't change it.

    The last ``tail`` characters are held back.  A cut never falls inside a span
    or a word, and is taken only if the scrubbed prefix is a prefix of the
    scrubbed whole.  Of what has been released the last ``back`` characters stay
    in view, for labels and context; so what is kept and scanned for a delta does
    not grow with the text."""

    def __init__(self, raw: str = "", emitted: str = "", consumed: int = 0, tail: int = TAIL, back: int = BACK):
        self.raw, self.emitted, self.consumed, self.tail, self.back = raw, emitted, consumed, tail, back

    def feed(self, delta: str) -> str:
        self.raw += delta
        limit = len(self.raw) - self.tail
        if limit <= self.consumed:
            return ""
        spans = find(self.raw)
        full = replaced(self.raw, spans)
        cut = limit
        for _ in range(4):
            cut = next((s for _, s, e, _ in spans if s < cut < e), cut)
            while cut > self.consumed and not self.raw[cut - 1].isspace():
                cut -= 1
            if cut <= self.consumed:
                return ""
            done = scrub(self.raw[:cut])
            if full.startswith(done) and done.startswith(self.emitted):
                return self._release(done, cut)
            cut -= 1
        return ""

    def flush(self, delta: str = "") -> str:
        """What is left to release, after a last ``delta``."""
        self.raw += delta
        done = scrub(self.raw) or ""
        if not done.startswith(self.emitted):
            self.emitted, self.consumed = done, len(self.raw)
            return done
        return self._release(done, len(self.raw))

    def _release(self, done: str, cut: int) -> str:
        out = done[len(self.emitted) :]
        self.emitted, self.consumed = done, cut
        if self.consumed > 2 * self.back:
            self._forget()
        return out

    def _forget(self) -> None:
        """Let go of released text before the last ``back`` characters, at a space outside of spans, if the rest is read alike without it."""
        start = self.consumed - self.back
        start = next((s for _, s, e, _ in find(self.raw) if s < start < e), start)
        while start > 0 and not self.raw[start - 1].isspace():
            start -= 1
        rest = scrub(self.raw[start : self.consumed])
        if start > 0 and self.emitted.endswith(rest):
            self.raw, self.emitted, self.consumed = self.raw[start:], rest, self.consumed - start


def scrub_stream(tokens: DataFrame, tail: int = TAIL) -> DataFrame:
    """Scrubbed deltas of a stream of ``tokens(answer_id, seq, delta, is_last)``: answer_id, seq, text.

    Deltas of an answer that come in one micro-batch are scrubbed together, under the number of the last of them: each scan
    costs the text in view, so one for every delta would cost that text once for every few characters."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raw, emitted, consumed = state.get if state.exists else ("", "", 0)
        s, out, ended = StableScrubber(raw, emitted, consumed, tail), [], False
        rows = pd.concat(list(batches)).sort_values("seq")
        together: list[str] = []
        for n, (seq, delta, last) in enumerate(zip(rows["seq"], rows["delta"], rows["is_last"], strict=True), 1):
            together.append(delta or "")
            if not last and n < len(rows):
                continue
            text = s.flush("".join(together)) if last else s.feed("".join(together))
            together, ended = [], ended or bool(last)
            if text:
                out.append((key[0], seq, text))
        if ended:
            state.remove()  # an answer that is over leaves nothing behind
        else:
            state.update((s.raw, s.emitted, s.consumed))
        yield pd.DataFrame(out, columns=["answer_id", "seq", "text"])

    return tokens.groupBy("answer_id").applyInPandasWithState(
        run, "answer_id long, seq long, text string", "raw string, emitted string, consumed int", "append", GroupStateTimeout.NoTimeout
    )


def backoff(failures: Column, base: float, most: float = 900.0) -> Column:
    """Seconds that a provider cools down after its n-th failure in a row."""
    return F.when(failures > 0, F.least(F.lit(most), base * F.pow(F.lit(2.0), F.least(failures, F.lit(40)) - 1))).otherwise(0.0)


def failure_runs(calls: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Adds failures: how many calls of the key in a row have failed up to this one."""
    w = W.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = calls.withColumn("_f", failed).withColumn("_island", island)
    inside = W.partitionBy(key, "_island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("failures", F.sum(F.col("_f").cast("int")).over(inside)).drop("_f", "_island")


#: What a spent quota says.
QUOTA = ("429", "rate limit", "rate_limit", "quota", "resource_exhausted", "too many requests", "insufficient_quota", "exceeded your current")


def is_quota_error(message: Column) -> Column:
    low = F.lower(message)
    return F.exists(F.array(*map(F.lit, QUOTA)), lambda m: F.contains(low, m))


def cooldown_wait(message: Column, most: float = 60.0) -> Column:
    """Seconds to wait out the cooldown that an error tells of, half a second more; null for other errors and long waits."""
    wait = F.nullif(F.regexp_extract(message, r"cooling down[^0-9]*([0-9]+(?:\.[0-9]+)?)s", 1), F.lit("")).cast("double") + 0.5
    return F.when(wait <= most, wait)


def quota_state(calls: DataFrame, key: str, order: list[str], failed: Column, base: Column, most: float = 900.0) -> DataFrame:
    """``key``, failures, until: the state behind a log of calls, each with a time ``at`` in seconds.

    A success resets; a failure cools the provider down until ``at`` plus its back-off."""
    runs = failure_runs(calls.withColumn("_base", base), key, order, failed)
    last = runs.groupBy(key).agg(F.max(F.struct(*order, "failures", "at", "_base")).alias("x")).select(key, "x.failures", "x.at", "x._base")
    pause = F.when(F.col("failures") > 0, F.least(F.lit(most), F.col("_base") * F.pow(F.lit(2.0), F.least("failures", F.lit(40)) - 1)))
    return last.select(key, "failures", F.when(pause.isNotNull(), F.col("at") + pause).otherwise(0.0).alias("until"))


def sanitised(saved: Column) -> Column:
    """map<provider, struct<until, failures>> of a saved state; entries that make no sense are left out, and so is a broken file."""
    raw = F.from_json(saved, "map<string,string>")
    one = F.transform_values(raw, lambda k, v: F.struct(
        F.coalesce(F.get_json_object(v, "$.until"), F.lit("0")).try_cast("double").alias("until"), F.coalesce(F.get_json_object(v, "$.failures"), F.lit("0")).try_cast("int").alias("failures"), v.startswith("{").alias("ok")
    ))
    good = F.map_filter(one, lambda k, v: v["ok"] & v["until"].isNotNull() & v["failures"].isNotNull())
    return F.transform_values(good, lambda k, v: F.struct(v["until"].alias("until"), v["failures"].alias("failures")))


def committed(attempts: DataFrame, key: list[str], order: list[str], tokens: Column) -> DataFrame:
    """The first attempt of each answer that gave a token: once one has come, no other provider is tried."""
    tried = attempts.withColumn("_t", tokens > 0).withColumn("_o", F.struct(*order))
    first = tried.where("_t").groupBy(*key).agg(F.min_by(F.struct(*[c for c in attempts.columns if c not in key]), "_o").alias("a"), F.min("_o").alias("_first"))
    before = tried.join(first.select(*key, "_first"), key).where(F.col("_o") < F.col("_first")).groupBy(*key).agg(F.count("*").alias("fallbacks"))
    return first.join(before, key, "left").select(*key, "a.*", F.coalesce("fallbacks", F.lit(0)).alias("fallbacks"))
