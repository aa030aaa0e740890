"""Typed state: what streams give is what tables give, and state ends."""

import time

import pytest

from foliant.plans.streams import in_parts
from foliant.streaming import state as S
from foliant.streaming import typed as T

SAID = {
    1: "Please call Mr. Rakesh Sharma at 9876543210 about the loan. " * 6,
    2: "Nothing to hide here, and " * 20,
    3: "PAN ABCDE1234F belongs to the applicant, who lives elsewhere. " * 5,
}


def tokens(spark, said=SAID, size=11):
    rows = []
    for a, text in said.items():
        parts = [text[i : i + size] for i in range(0, len(text), size)]
        rows += [(a, i, p, i == len(parts) - 1) for i, p in enumerate(parts)]
    return spark.createDataFrame(rows, "answer_id long, seq long, delta string, is_last boolean")


def joined(out):
    held = {}
    for r in sorted(out.collect(), key=lambda r: (r["answer_id"], r["seq"])):
        held[r["answer_id"]] = held.get(r["answer_id"], "") + r["text"]
    return held


def scrubbed(text):
    s = S.StableScrubber()
    return s.feed(text) + s.flush()


def test_deltas_out_of_turn_give_the_scrubbed_answers(spark):
    t = tokens(spark)
    want = {a: scrubbed(text) for a, text in SAID.items()}
    assert "ABCDE1234F" not in want[3]
    odd, again = t.where("seq % 2 = 1"), t.where("seq % 5 < 2")
    assert joined(in_parts(spark, [odd, again, t.where("seq % 2 = 0")], T.scrub_answers)) == want


def running(spark, folder, parts, job, done):
    """What a query that keeps running has given once ``done`` holds of it; parts arrive two seconds apart.  A minute at most."""
    source, sink, began = f"{folder}/source", f"{folder}/sink", time.time()
    parts[0].write.parquet(source)
    out = job(spark.readStream.schema(parts[0].schema).parquet(source))
    query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{folder}/state").trigger(processingTime="200 milliseconds").start()
    try:
        for part in parts[1:]:
            while time.time() < began + 60 and not (query.lastProgress and query.lastProgress.batchId > 0):
                time.sleep(0.2)
            time.sleep(2)
            part.write.mode("append").parquet(source)
        while time.time() < began + 60:
            rows = spark.read.schema(out.schema).parquet(sink)
            if done(rows):
                break
            time.sleep(0.5)
    finally:
        query.stop()
    return spark.read.schema(out.schema).parquet(sink)


def test_an_abandoned_answer_is_given_and_its_state_goes(spark, tmp_path):
    """An answer stops without its last delta and with a gap; its rest comes when its time is over, scrubbed."""
    cut = tokens(spark).where("answer_id = 3 AND seq < 20 AND seq <> 15")
    text = "".join(r["delta"] for r in cut.orderBy("seq").collect())
    out = running(spark, str(tmp_path), [cut], lambda s: T.scrub_answers(s, idle_ms=500), lambda rows: rows.where("seq = 19").count())
    assert joined(out) == {3: scrubbed(text)} and "ABCDE1234F" not in scrubbed(text)


def calls(spark, rows):
    return spark.createDataFrame(rows, "provider string, call_id long, at double, failed boolean, base double")


def test_cooldowns_by_hand(spark):
    a = [("a", 1, 0.0, True, 20.0), ("a", 2, 5.0, True, 60.0), ("b", 3, 6.0, True, 20.0), ("b", 4, 7.0, None, 20.0), ("c", 9, 1.0, False, 20.0)]
    b = [("a", 5, 9.0, True, 300.0), ("b", 6, 9.0, True, 20.0), ("a", 8, 11.0, True, 20.0), ("a", 7, 10.0, False, 20.0)]
    out = in_parts(spark, [calls(spark, a), calls(spark, b)], T.cooldowns)
    assert sorted(tuple(r) for r in out.collect()) == [
        ("a", 1, 1, 20.0, 20.0), ("a", 2, 2, 120.0, 125.0), ("a", 5, 3, 900.0, 909.0), ("a", 8, 1, 20.0, 31.0), ("b", 3, 1, 20.0, 26.0), ("b", 6, 1, 20.0, 29.0),
    ]


def test_a_streak_that_rests_is_forgotten(spark, tmp_path):
    parts = [calls(spark, [("a", 1, 0.0, True, 20.0)]), calls(spark, [("a", 3, 9.0, True, 20.0)])]
    out = running(spark, str(tmp_path), parts, lambda s: T.cooldowns(s, idle_ms=500), lambda rows: rows.count() == 2)
    assert {r["call_id"]: r["failures"] for r in out.collect()} == {1: 1, 3: 1}


@pytest.mark.parametrize("trigger,keep", [(5, 2), (2, 4), (0, 0)])
def test_summaries_whatever_the_order(spark, trigger, keep):
    """Late turns, blank ones, other roles and null columns: the turns that a table of all of them folds."""
    from foliant.operators.dialogue import overflow

    rows = [(c, t, "system" if t == 4 else ("user", "assistant")[t % 2], None if t == 7 else f"said {t}") for c in range(4) for t in range(3 * c + 2)]
    rows.append((9, 1, None, "x"))
    m = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = in_parts(spark, [m.where("turn % 3 = 2"), m.where("turn % 3 = 0"), m.where("turn % 3 = 1")], lambda s: T.summary_turns(s, trigger, keep))
    got = sorted((r["conv_id"], r["turn"], r["text"]) for r in out.collect())
    assert got == sorted((r["conv_id"], r["turn"], r["text"]) for r in overflow(m, trigger, keep).collect()) and got
