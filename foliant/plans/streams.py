"""Queries of streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.plans import dialogue
from foliant.sources.scratch import folder, written
from foliant.sources.tables import table
from foliant.streaming import state as S
from foliant.streaming import typed as T


def events(spark, d):
    return table(spark, d, "events")


def stream_scrub(spark, d):
    """Turns of conversations as streams of 24-character deltas, scrubbed on the way; the joined output per turn."""
    t = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), "text")
    n = F.greatest(F.ceil(F.length("text") / 24), F.lit(1)).cast("int")
    cut = t.select("answer_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * 24 + 1, F.lit(24)))).alias("seq", "delta"), n.alias("_n"))
    cut = cut.select("answer_id", F.col("seq").cast("long"), "delta", (F.col("seq") == F.col("_n") - 1).alias("is_last"))
    source, sink = written(cut, "deltas"), f"{folder(spark)}/foliant/scrubbed-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(cut.schema).parquet(source.inputFiles()[0].rsplit("/", 1)[0])
    query = S.scrub_stream(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema("answer_id long, seq long, text string").parquet(sink)
    held = out.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("x"))
    return held.select("answer_id", F.md5(F.array_join(F.transform("x", lambda v: v["text"]), "")).alias("text_md5"))


def in_parts(spark, parts, job):
    """What ``job`` gives of a stream whose rows come in ``parts``; it is stopped after each and goes on from its checkpoint."""
    source, sink = (f"{folder(spark)}/foliant/{what}-{uuid.uuid4().hex}" for what in ("arriving", "streamed"))
    for part in parts:
        part.write.mode("append").parquet(source)
        out = job(spark.readStream.schema(part.schema).parquet(source))
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def stream_summaries(spark, d):
    """Turns to fold into summaries, of conversations whose middle turns come late."""
    talk = table(spark, d, "conversations")
    late = F.col("turn") % 3 == 1
    return in_parts(spark, [talk.where(~late), talk.where(late)], lambda s: T.summary_turns(s, trigger=4, keep=3)).select("conv_id", F.col("turn").cast(talk.schema["turn"].dataType))


def stream_cooldown(spark, d):
    """The rows of ``cooldown_backoff``, of a stream that is stopped half-way."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    calls = events(spark, d).select(F.col("user_id").alias("provider"), F.col("event_id").alias("call_id"), at.alias("at"), (F.col("event_type") == "error").alias("failed"), F.lit(20.0).alias("base"))
    half = calls.agg(F.expr("(min(at) + max(at)) div 2")).first()[0]
    parts = [calls.where(F.col("at") < half), calls.where(F.col("at") >= half)]
    out = in_parts(spark, parts, lambda s: T.cooldowns(s.withColumn("at", F.col("at") / 1e6), most=1e18))
    return out.select(F.col("call_id").alias("event_id"), F.col("provider").alias("user_id"), "failures", "cooldown_s")


def cooldown_backoff(spark, d):
    e = S.failure_runs(events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return e.where("failures > 0").select("event_id", "user_id", "failures", S.backoff(F.col("failures"), 20.0).alias("cooldown_s"))


def quota_errors(spark, d):
    """Messages made of events: codes, limits, resource and network errors."""
    said = ("HTTP 4", "Rate LIMIT reached by ", "connection reset by ", "RESOURCE_EXHAUSTED: ", "timeout of ", "monthly Quota is used up by ")
    k = F.col("event_id")
    message = F.concat(F.get(F.array(*map(F.lit, said)), (k % 6).cast("int")), (k % 40).cast("string"), F.lit(" "), "event_type")
    return events(spark, d).select("event_id", S.is_quota_error(message).alias("quota"))


def stream_commit(spark, d):
    """A user's day as one answer, its events as attempts; errors give no token."""
    e = events(spark, d).select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    tokens = F.when(F.col("event_type") == "error", 0).otherwise(1)
    return S.committed(e, ["user_id", "day"], ["ts", "event_id"], tokens).select("user_id", F.col("day").cast("string").alias("day"), "event_id", F.col("event_type").alias("provider"), "fallbacks")


def events_tumbling(spark, d):
    w = events(spark, d).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def events_session(spark, d):
    w = events(spark, d).groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {f.__name__: f for f in (stream_scrub, stream_summaries, stream_cooldown, cooldown_backoff, quota_errors, stream_commit, events_tumbling, events_session)}

SQL = {
    "stream_summaries": dialogue.SQL["summary_overflow"],
    "cooldown_backoff": """
WITH i AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
f AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS failures FROM i)
SELECT event_id, user_id, failures, least(900.0, 20.0 * pow(2, least(failures, 40) - 1))::DOUBLE AS cooldown_s FROM f WHERE failures > 0""",
    "quota_errors": f"""
WITH m AS (SELECT event_id, lower((['HTTP 4', 'Rate LIMIT reached by ', 'connection reset by ', 'RESOURCE_EXHAUSTED: ', 'timeout of ', 'monthly Quota is used up by '])[event_id % 6 + 1] || event_id % 40 || ' ' || event_type) AS m FROM events)
SELECT event_id, {' OR '.join(f'contains(m, {q!r})' for q in S.QUOTA)} AS quota FROM m""",
    "stream_commit": """
WITH e AS (SELECT user_id, ts::DATE AS day, event_id, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, day::VARCHAR AS day, event_id, event_type AS provider, r - 1 AS fallbacks FROM e WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY r) = 1""",
    "events_tumbling": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_session": """
WITH g AS (SELECT user_id, ts, (coalesce(ts - lag(ts) OVER w >= INTERVAL '30 minutes', TRUE))::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
SQL["stream_cooldown"] = SQL["cooldown_backoff"].replace("least(900.0, 20.0 * pow(2, least(failures, 40) - 1))", "20.0 * pow(2, least(failures, 40) - 1)")
