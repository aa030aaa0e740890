"""Queries of conversations, gates, routing and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import dialogue as D
from foliant.plans import retrieval as R
from foliant.plans.text import strip, typed
from foliant.sources.tables import table


def talk(spark, d):
    return table(spark, d, "conversations")


def history_window(spark, d):
    return D.history(talk(spark, d), 4, 120).select("conv_id", "turn", "role", "text")


def summary_overflow(spark, d):
    return D.overflow(talk(spark, d), trigger=4, keep=3).select("conv_id", "turn")


def transcript(spark, d):
    return D.transcript(talk(spark, d)).select("conv_id", F.md5("transcript").alias("transcript_md5"))


def followup_flag(spark, d):
    return talk(spark, d).select("conv_id", "turn", D.is_followup(F.col("text")).alias("followup"))


def expansion_gate(spark, d):
    return talk(spark, d).select("conv_id", "turn", D.should_expand(F.col("text")).alias("expand"))


def validate_query(spark, d):
    return talk(spark, d).select("conv_id", "turn", D.validation(F.when(F.col("turn") % 3 == 0, F.lit("  ")).otherwise(F.col("text")), 300).alias("verdict"))


def conversation_list(spark, d):
    t = talk(spark, d)
    return D.listed(t.where("role = 'user'"), t.select("conv_id").distinct()).select("conv_id", "messages", "last_turn")


def message_count(spark, d):
    return talk(spark, d).groupBy("conv_id", "role").agg(F.count("*").alias("messages"))


def latest_conversations(spark, d):
    """The twenty with the latest turns."""
    last = talk(spark, d).groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return last.orderBy(F.desc("last_turn"), F.desc("conv_id")).limit(20)


#: Words that begin questions of every intent and of none; each turn gets one before its text.
OPENINGS = (
    "Compare this and flag any risk:", "Summarize the key terms in brief:", "What is the amount and when:", "Hello there,", "Why does it meet the limit?", "Who is it? Explain.", "tl;dr", "Describe the rate, the date and the name of",
    "does this satisfy it", "defaulted overview highlights summary",
)


def _asked(spark, d):
    opening = F.get(F.array(*map(F.lit, OPENINGS)), ((F.col("conv_id") * 3 + F.col("turn")) % len(OPENINGS)).cast("int"))
    return talk(spark, d).select("conv_id", "turn", F.concat(opening, F.lit(" "), "text").alias("q"))


def intent_classify(spark, d):
    return _asked(spark, d).select("conv_id", "turn", D.intent(F.col("q")).alias("intent"))


def intent_of_talk(spark, d):
    return talk(spark, d).select("conv_id", "turn", D.intent(F.col("text")).alias("intent"))


def route_order(spark, d):
    k = F.col("conv_id") + F.col("turn")
    available = F.when(k % 2 == 0, F.array(*map(F.lit, ("nvidia", "groq", "local")))).otherwise(F.array(F.lit("gemini"), F.lit("nvidia")))
    cooling = F.when(k % 3 == 0, F.array(F.lit("nvidia"))).otherwise(F.array().cast("array<string>"))
    named = _asked(spark, d).select("conv_id", "turn", D.intent(F.col("q")).alias("intent"))
    return named.select("conv_id", "turn", F.array_join(D.provider_order(F.col("intent"), available, cooling), ",").alias("providers"))


def refusal_flag(spark, d):
    said = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" This is NOT stated here."))).otherwise(F.col("text"))
    return talk(spark, d).select("conv_id", "turn", D.refuses(said).alias("refuses"))


def _ranked(spark, d):
    docs = table(spark, d, "documents")
    found = R.best(spark, d, 6)
    page = F.when(F.col("doc_id") % 5 == 0, F.lit("n/a")).otherwise((F.col("doc_id") % 3).cast("string"))
    return found.join(docs.select("doc_id", "source", F.col("text").alias("content")), "doc_id").select(
        "query_id", "rank", "score", F.col("source").alias("document_id"), page.alias("page_number"), F.concat("source", F.lit(".txt")).alias("filename"), "content"
    )


def context_blocks(spark, d):
    return D.context_blocks(_ranked(spark, d)).select("query_id", F.md5("context").alias("context_md5"))


def citations(spark, d):
    return D.citations(_ranked(spark, d)).select("query_id", "n", "document_id", "page_number", "score", "snippet")


def simulated_answer(spark, d):
    return D.context_blocks(_ranked(spark, d)).join(R.items(spark, d), "query_id").select("query_id", D.simulated_answer(F.col("text"), F.col("context")).alias("answer"))


def login_resolution(spark, d):
    """Customers as accounts, some without a subject or disabled; orders as claims, by subject, by address in other case, or by neither."""
    c, k = table(spark, d, "customer"), F.col("o_orderkey")
    a = c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit(" User"), "c_custkey", F.lit("@X.org")).alias("email"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("s"), "c_custkey")).alias("sub"), F.when(F.col("c_custkey") % 5 == 0, "disabled").otherwise("active").alias("status"))
    sub = F.when(k % 2 == 0, F.concat(F.lit("s"), "o_custkey")).otherwise(F.concat(F.lit("t"), "o_custkey"))
    mail = F.when(k % 7 > 0, F.concat(F.lit("USER"), "o_custkey", F.lit("@x.ORG ")))
    return D.login(a, table(spark, d, "orders").select(k.alias("claim_id"), sub.alias("claim_sub"), mail.alias("claim_email")))


QUERIES = {f.__name__: f for f in (
    history_window, summary_overflow, transcript, followup_flag, expansion_gate, validate_query, conversation_list, message_count, latest_conversations, intent_classify,
    intent_of_talk, route_order, refusal_flag, context_blocks, citations, simulated_answer, login_resolution,
)}

_KEPT = f"kept AS (SELECT conv_id, turn, role, {strip('text')} AS text FROM conversations WHERE role IN ('user', 'assistant') AND {strip('text')} <> '')"
_WORDS = rf"CASE WHEN {strip('text')} = '' THEN 0 ELSE len(string_split_regex({strip('text')}, '\s+')) END"
_STARTS = " OR ".join(f"starts_with(t, '{m}')" for m in D.FOLLOWUP)


def _intent(c: str) -> str:
    s = {k: "(" + " + ".join(f"regexp_matches(lower({c}), '{p}')::INT" for p in ps) + ")" for k, ps in D.INTENTS.items()}
    best = f"greatest({', '.join(s.values())})"
    return f"CASE WHEN {best} = 0 THEN 'general' " + " ".join(f"WHEN {v} = {best} THEN '{k}'" for k, v in s.items()) + " END"


_RANKED = f"""WITH {R.bm25_ctes()}, ranked AS (SELECT r.query_id, r.rank, r.score, source AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'n/a' ELSE (doc_id % 3)::VARCHAR END AS page_number,
  source || '.txt' AS filename, text AS content FROM ({R.first_k('scores', 6)}) r JOIN documents USING (doc_id)),
ctx AS (SELECT query_id, string_agg('[Doc: ' || filename || ' | Page ' || page_number || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM ranked GROUP BY query_id)"""
_PREF = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.PREFERRED.items()) + " END"
_ASKED = "asked AS (SELECT conv_id, turn, (" + str([o for o in OPENINGS]) + ")[(conv_id * 3 + turn) % 10 + 1] || ' ' || text AS q FROM conversations)"
_REFUSE = " OR ".join(f"contains(t, '{m}')" for m in D.REFUSALS)

SQL = {
    "history_window": rf"""WITH {_KEPT}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM kept)
SELECT conv_id, turn, role, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substring(text, 1, 119), '\s+$', '') || '…' END AS text FROM r WHERE back <= 4""",
    "summary_overflow": f"""WITH {_KEPT}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM kept)
SELECT conv_id, turn FROM r WHERE n > 4 AND back > 3""",
    "transcript": "SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE role END || ': ' || text, chr(10) ORDER BY turn)) AS transcript_md5 FROM conversations GROUP BY conv_id",
    "followup_flag": f"SELECT conv_id, turn, t <> '' AND (n <= 6 OR {_STARTS}) AS followup FROM (SELECT conv_id, turn, lower({strip('text')}) AS t, {_WORDS} AS n FROM conversations)",
    "expansion_gate": f"SELECT conv_id, turn, {_WORDS} >= 7 AS expand FROM conversations",
    "validate_query": f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR {strip('text')} = '' THEN 'empty' WHEN length({strip('text')}) > 300 THEN 'too_long' ELSE 'ok' END AS verdict FROM conversations",
    "conversation_list": "SELECT c.conv_id, count(m.conv_id) AS messages, max(m.turn) AS last_turn FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN conversations m ON m.conv_id = c.conv_id AND m.role = 'user' GROUP BY c.conv_id",
    "message_count": "SELECT conv_id, role, count(*) AS messages FROM conversations GROUP BY conv_id, role",
    "latest_conversations": "SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id DESC LIMIT 20",
    "intent_classify": f"WITH {_ASKED} SELECT conv_id, turn, {_intent('q')} AS intent FROM asked",
    "intent_of_talk": f"SELECT conv_id, turn, {_intent('text')} AS intent FROM conversations",
    "route_order": f"""
WITH {_ASKED}, q AS (SELECT conv_id, turn, {_intent('q')} AS intent, CASE WHEN (conv_id + turn) % 2 = 0 THEN ['nvidia', 'groq', 'local'] ELSE ['gemini', 'nvidia'] END AS a, CASE WHEN (conv_id + turn) % 3 = 0 THEN ['nvidia'] ELSE [] END AS c FROM asked),
w AS (SELECT conv_id, turn, a, c, list_concat(list_concat([{_PREF}], ['groq', 'nvidia', 'gemini']), a) AS w FROM q),
u AS (SELECT conv_id, turn, c, list_filter(w, lambda p, i: list_contains(a, p) AND list_position(w, p) = i) AS u FROM w)
SELECT conv_id, turn, array_to_string(list_concat(list_filter(u, lambda p: NOT list_contains(c, p)), list_filter(u, lambda p: list_contains(c, p))), ',') AS providers FROM u""",
    "refusal_flag": f"SELECT conv_id, turn, {_REFUSE} AS refuses FROM (SELECT conv_id, turn, lower(CASE WHEN turn % 2 = 0 THEN text || ' This is NOT stated here.' ELSE text END) AS t FROM conversations)",
    "context_blocks": f"{_RANKED} SELECT query_id, md5(context) AS context_md5 FROM ctx",
    "citations": f"""{_RANKED}, b AS (SELECT * FROM ranked WHERE page_number <> 'n/a' QUALIFY row_number() OVER (PARTITION BY query_id, document_id, page_number ORDER BY score DESC, rank) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS n, document_id, page_number::INT AS page_number, score, substring(content, 1, 220) AS snippet FROM b""",
    "simulated_answer": f"{_RANKED} SELECT query_id, '[SIMULATED] Answer to ''' || substring(text, 1, 80) || ''' based on ' || length({strip('context')}) || ' chars of context.' AS answer FROM ctx JOIN q USING (query_id)",
    "login_resolution": f"""
WITH a AS (SELECT c_custkey AS user_id, ' User' || c_custkey || '@X.org' AS email, CASE WHEN c_custkey % 3 > 0 THEN 's' || c_custkey END AS sub, CASE WHEN c_custkey % 5 = 0 THEN 'disabled' ELSE 'active' END AS status FROM customer),
c AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 2 = 0 THEN 's' ELSE 't' END || o_custkey AS claim_sub, CASE WHEN o_orderkey % 7 > 0 THEN 'USER' || o_custkey || '@x.ORG ' END AS claim_email FROM orders),
f AS (SELECT claim_id, claim_sub, CASE WHEN s.user_id IS NOT NULL THEN s ELSE m END AS w FROM c LEFT JOIN a s ON s.sub = claim_sub LEFT JOIN a m ON lower(trim(m.email)) = lower(trim(claim_email)))
SELECT claim_id, CASE WHEN w.status = 'active' AND (w.sub IS NULL OR w.sub = claim_sub) THEN w.user_id END AS user_id FROM f""",
}
SQL["citations"] = typed(SQL["citations"], n="INTEGER")
