"""Streaming operators on typed state that ends: with the answer, with a success, or when nothing has come for a while.

All three take a stream.  They need the state store that holds typed
state and timers (:func:`typed_state`).  ``idle_ms`` is the time without a row of a
key after which its state goes; without it there are no timers, and state goes by
the rows alone.  Timers need a query that keeps running: one with ``idle_ms`` asks
for batches without rows, and doesn't end under the trigger ``availableNow``.  A micro-batch's rows of one key are put in order together, so the
size of a micro-batch bounds what one task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.operators.dialogue import turns
from foliant.streaming.state import TAIL, StableScrubber

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def typed_state(spark: SparkSession) -> None:
    """Have queries that start from now on keep state where it may be typed; a provider that the user chose stays, and so does that of an old checkpoint."""
    if spark.conf.get(_PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)


class _Kept(StatefulProcessor):
    """State of a key with a timer that every row sets anew."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, live = self.take(key, pd.concat(list(rows)))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if live:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.ended(key)

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, processor: _Kept, schema: str) -> DataFrame:
    typed_state(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "none" if processor.idle_ms is None else "processingTime")


class _Answers(_Kept):
    columns = ["answer_id", "seq", "text"]

    def __init__(self, tail: int, idle_ms: int | None):
        super().__init__(idle_ms)
        self.tail = tail

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getValueState("said", "raw string, emitted string, consumed int, next long")
        self.early = handle.getMapState("early", "seq long", "delta string, is_last boolean")

    def _held(self) -> tuple[StableScrubber, int, dict]:
        raw, emitted, consumed, following = self.said.get() if self.said.exists() else ("", "", 0, 0)
        early = {k[0]: tuple(v) for k, v in self.early.iterator()} if self.early.exists() else {}
        return StableScrubber(raw, emitted, consumed, self.tail), following, early

    def _forget(self) -> None:
        self.said.clear()
        self.early.clear()

    def take(self, key: tuple, rows: pd.DataFrame) -> tuple[pd.DataFrame, bool]:
        s, following, early = self._held()
        had = bool(early)
        early |= {int(q): (d or "", bool(e)) for q, d, e in zip(rows["seq"], rows["delta"], rows["is_last"], strict=True) if q >= following}
        out, over = [], following < 0
        while following in early and not over:
            delta, over = early.pop(following)
            text = s.feed(delta) + (s.flush() if over else "")
            if text:
                out.append((key[0], following, text))
            following += 1
        if over:
            self._forget()
        else:
            self.said.update((s.raw, s.emitted, s.consumed, following))
            if had:
                self.early.clear()
            for q, v in early.items():
                self.early.updateValue((q,), v)
        return pd.DataFrame(out, columns=self.columns), not over

    def ended(self, key: tuple) -> pd.DataFrame:
        s, following, early = self._held()
        last = max(early, default=following - 1)
        text = "".join(s.feed(early[q][0]) for q in sorted(early)) + s.flush()
        self._forget()
        return pd.DataFrame([(key[0], last, text)] if text else [], columns=self.columns)


def scrub_answers(tokens: DataFrame, tail: int = TAIL, idle_ms: int | None = None) -> DataFrame:
    """Scrubbed deltas of ``tokens(answer_id, seq, delta, is_last)``, seq from 0: answer_id, seq, text.

    A delta that comes before its turn waits in the state; one that comes again while the answer lasts is left out; a null delta
    says nothing.  An answer whose last delta hasn't come after ``idle_ms`` is abandoned: what waits is scrubbed and given,
    in order, whatever is missing between, and its state goes."""
    return _run(tokens.select("answer_id", "seq", "delta", "is_last"), "answer_id", _Answers(tail, idle_ms), "answer_id long, seq long, text string")


class _Cooldowns(_Kept):
    columns = ["provider", "call_id", "failures", "cooldown_s", "until"]

    def __init__(self, most: float, idle_ms: int | None):
        super().__init__(idle_ms)
        self.most = most

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "failures long")

    def take(self, key: tuple, rows: pd.DataFrame) -> tuple[pd.DataFrame, bool]:
        before = failures = self.streak.get()[0] if self.streak.exists() else 0
        out = []
        rows = rows.sort_values(["at", "call_id"])
        for call, at, failed, base in zip(rows["call_id"], rows["at"], rows["failed"], rows["base"], strict=True):
            failures = failures + 1 if failed else 0
            if failures:
                pause = min(self.most, base * 2.0 ** (min(failures, 40) - 1))
                out.append((key[0], call, failures, pause, at + pause))
        if failures:
            self.streak.update((failures,))
        elif before:
            self.streak.clear()
        return pd.DataFrame(out, columns=self.columns), failures > 0

    def ended(self, key: tuple) -> pd.DataFrame:
        self.streak.clear()
        return pd.DataFrame([], columns=self.columns)


def cooldowns(calls: DataFrame, most: float = 900.0, idle_ms: int | None = None) -> DataFrame:
    """Of a stream of ``calls(provider, call_id, at, failed, base)``, ``at`` in seconds, each failure with its place in the streak and the cooldown that follows.

    Calls of one micro-batch are ordered by at and call_id, micro-batches as they come.  A success ends the state of its provider; a
    null ``failed`` is a success.  A streak that rests for ``idle_ms`` is forgotten."""
    rows = calls.select("provider", "call_id", F.col("at").cast("double"), F.coalesce("failed", F.lit(False)).alias("failed"), F.col("base").cast("double"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("provider", "call_id")}
    return _run(rows, "provider", _Cooldowns(most, idle_ms), f"provider {kinds['provider']}, call_id {kinds['call_id']}, failures long, cooldown_s double, until double")


class _Summaries(_Kept):
    columns = ["conv_id", "turn", "role", "text"]

    def __init__(self, trigger: int, keep: int, idle_ms: int | None):
        super().__init__(idle_ms)
        self.trigger, self.keep = trigger, keep

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")
        self.recent = handle.getListState("recent", "turn long, role string, text string")

    def take(self, key: tuple, rows: pd.DataFrame) -> tuple[pd.DataFrame, bool]:
        n = (self.seen.get()[0] if self.seen.exists() else 0) + len(rows)
        held = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        held = sorted([*held, *zip(rows["turn"].tolist(), rows["role"], rows["text"], strict=True)], key=lambda r: r[0])
        folds = max(len(held) - self.keep, 0) if n > self.trigger else 0
        self.seen.update((n,))
        self.recent.put(held[folds:]) if held[folds:] else self.recent.clear()
        return pd.DataFrame([(key[0], *r) for r in held[:folds]], columns=self.columns), True

    def ended(self, key: tuple) -> pd.DataFrame:
        self.seen.clear()
        self.recent.clear()
        return pd.DataFrame([], columns=self.columns)


def summary_turns(messages: DataFrame, trigger: int = 12, keep: int = 6, idle_ms: int | None = None) -> DataFrame:
    """Turns of a stream of ``messages(conv_id, turn, role, text)`` to fold into the summary of their conversation, each once, as soon as it is due.

    Those of :func:`foliant.operators.dialogue.overflow` over all that has come.  A turn leaves the last ``keep`` for good, since
    later turns only push it further; so it is given and let go, and the state of a conversation has a count and at most
    ``trigger`` or ``keep`` turns, whichever is more.  A late turn takes its place by number: it is given at once if it is older than the last ``keep``.  Turns of
    equal number keep the order in which they came.  ``idle_ms`` ends a conversation; a turn after that begins a new one."""
    rows = turns(messages).select("conv_id", F.col("turn").cast("long"), "role", "text")
    return _run(rows, "conv_id", _Summaries(trigger, keep, idle_ms), "conv_id long, turn long, role string, text string")
