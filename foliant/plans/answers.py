"""Queries of gates, prompts, model inputs, run reports, registries and saved state."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import answer as A
from foliant.operators import bm25, dense
from foliant.operators import dialogue as D
from foliant.operators import evaluate as E
from foliant.operators import extract as X
from foliant.operators import quality as Q
from foliant.operators import redact as P
from foliant.plans import evaluation as V
from foliant.plans import redaction
from foliant.plans import retrieval as R
from foliant.plans.dialogue import _RANKED, _ranked
from foliant.plans.text import squash, strip, tok, typed
from foliant.sources import golden
from foliant.sources.tables import table
from foliant.streaming import state as S


def docs(spark, d):
    return table(spark, d, "documents")


def talk(spark, d):
    return table(spark, d, "conversations")


def _scoped(spark, d):
    """Questions about sources, some of which no document has; every seventh is blank."""
    scope = F.when(F.col("query_id") % 3 > 0, F.concat(F.lit("src"), (F.col("query_id") % 40).cast("string")))
    text = F.when(F.col("query_id") % 7 == 0, "  ").otherwise(F.col("text"))
    return R.items(spark, d).select("query_id", text.alias("text"), scope.alias("scope"))


def refused_questions(spark, d):
    wrong = F.nullif(D.validation(F.col("text")), F.lit("ok"))
    q = _scoped(spark, d).withColumn("wrong", wrong)
    return A.refused(q, docs(spark, d).select(F.col("source").alias("document_id")), F.col("wrong"))


def unanswered_questions(spark, d):
    """Questions that share no word of six letters or more with their source."""
    q = _scoped(spark, d)
    words = lambda c: F.array_distinct(F.filter(T.tokens(c), lambda t: F.length(t) >= 6))
    asked = q.select("query_id", "scope", F.explode(words("text")).alias("w"))
    held = docs(spark, d).select(F.col("source").alias("s"), F.explode(words("text")).alias("w")).distinct()
    return A.unanswered(q, asked.join(held, "w").where("scope is null or scope = s"))


def raw_query_fallback(spark, d):
    """Rewritten questions of which every third means nothing; those are asked as they were."""
    raw = R.items(spark, d)
    made = raw.withColumn("text", F.when(F.col("query_id") % 3 == 0, "zzqx qqzz").otherwise(F.col("text")))
    found = lambda q: R.ranked(bm25.search(R.index(spark, d), q, 3))
    return A.fallback(found(made), found(raw))


def variant_dedupe(spark, d):
    w = F.split("text", " ")
    same = F.concat(F.lit("  "), F.upper(F.translate("text", "ß", "s")), F.lit(" "))
    some = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    q = R.items(spark, d).withColumn("text", F.translate("text", "ß", "s"))
    return A.variants(q, F.array(same, some(1, 3), F.concat(some(1, 1), F.lit("   "), some(2, 2)), F.lit(" "), some(2, 4)), 3).select("query_id", "variant", F.md5("text").alias("text_md5"))


def _fixed(spark, d):
    """Questions and ranked chunks, scrubbed by the fixed shapes."""
    return A.model_inputs(R.items(spark, d), _ranked(spark, d), lambda text, carry: P.redact_fixed(text))


def model_input(spark, d):
    whole, _ = _fixed(spark, d)
    return whole.select("query_id", F.md5("question").alias("question_md5"), F.md5("context").alias("context_md5"))


def model_pages(spark, d):
    """The text that a model is given of each page, pages ranked more than once joined in order."""
    return _fixed(spark, d)[1].select("query_id", "document_id", "page_number", F.md5("text").alias("text_md5"))


def prompt_assembly(spark, d):
    whole, _ = _fixed(spark, d)
    summary = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("Topic "), F.col("query_id").cast("string")))
    made = A.prompts(A.scrubbed(whole.withColumn("summary", summary), "summary", P.redact_fixed), "question", "context", "Answer from the context.", "summary")
    return made.select("query_id", "system", F.md5("prompt").alias("prompt_md5"))


def rewrite_request(spark, d):
    """The last user turn of each conversation as the question, the last four turns before it as history."""
    t = A.scrubbed(talk(spark, d), "text", P.redact_fixed)
    last = t.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("_last"))
    q = t.join(last, "conv_id").where("turn = _last").select("conv_id", "text").withMetadata("text", A.MARK)
    before = t.join(last, "conv_id").where("turn < _last")
    kept = D.history(before, 4, 120).select("conv_id", "turn", "role", "text").withMetadata("text", A.MARK)
    return A.rewrite_inputs(q, kept).select("conv_id", F.md5("request").alias("request_md5"))


def _swap(text):
    """A stand-in for a rewriting model: it fails on some texts, gives nothing for others, and quotes the rest."""
    if "redacted" in text:
        raise ValueError(text)
    return "" if len(text) % 3 == 0 else f'"{text[:40].strip()}"' if len(text) % 3 == 1 else "[SIMULATED] " + text


def standalone_question(spark, d):
    t = A.scrubbed(talk(spark, d), "text", lambda c: F.regexp_replace(c, "[^ -~]", "?")).withColumnRenamed("text", "q").withMetadata("q", A.MARK)
    made = A.standalone(t, "q", "q", D.is_followup(F.col("q")) | (F.col("turn") % 2 == 0), _swap)
    return made.select("conv_id", "turn", F.md5("search_text").alias("text_md5"))


def stream_materialise(spark, d):
    """Turns cut into deltas and put together again; the last delta of every fifth is missing."""
    n = F.greatest(F.ceil(F.length("text") / 24), F.lit(1)).cast("int")
    t = talk(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), "text", n.alias("n"))
    cut = t.select("answer_id", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("text", i * 24 + 1, F.lit(24)))).alias("seq", "delta"))
    last = F.col("seq") == F.col("n") - 1
    cut = cut.withColumn("is_last", last).where(~(last & (F.col("answer_id") % 5 == 0) & (F.col("n") > 1)))
    return A.materialised(cut).select("answer_id", F.md5("text").alias("text_md5"), "complete")


def answer_relevance(spark, d):
    return E.relevance(V._answers(spark, d), ["conv_id", "turn"], "answer", "context", dense.embed)


def citation_metrics(spark, d):
    said, refs = V._cited(spark, d)
    said = said.withColumn("answer", F.when(F.col("query_id") % 4 == 0, "nothing cited").otherwise(F.col("answer")))
    return E.cited(said, refs)


def _run_rows(spark, d):
    """One row for each benchmark item that was ranked: ranking measures, an answer, its citations and made-up timings."""
    said, refs = V._cited(spark, d)
    k = F.col("query_id")
    answer = F.when(k % 5 == 0, F.lit(A.NO_CONTEXT)).when(k % 5 == 1, F.concat(F.lit("PAN ABCDE1234F in "), "answer")).when(k % 5 == 2, "no source").otherwise(F.col("answer"))
    said = said.withColumn("answer", answer)
    m = V.metrics(spark, d).withColumn("context_precision", F.col("average_precision")).withColumn("context_recall", F.when(k % 3 > 0, F.col("recall_at_k")))
    rows = m.join(said, "query_id").join(E.cited(said, refs), "query_id")
    return rows.select(
        "query_id", "hit_at_k", "recall_at_k", "precision_at_k", "ndcg_at_k", "mrr_at_k", "context_precision", "context_recall", F.col("answer").alias("answer_text"), "cited_count", "cited_ok",
        (k % 5 > 1).alias("answer_correct"), (k % 4).alias("answer_claims"), ((k % 7) / 10).alias("groundedness"), ((k % 3) / 4).alias("ungrounded_fraction"), F.when(k % 2 == 0, (k % 9) / 8).alias("answer_relevance"),
        F.when(k % 3 == 0, k % 2).alias("nli_claim_count"), ((k % 5) / 4).alias("nli_entailed_fraction"), F.when(k % 4 > 0, (k % 5) / 8).alias("nli_contradiction_fraction"),
        (P.leak_score(F.col("answer")) > 0).alias("pii_leaked"), (k % 6 - 4).alias("fallbacks_tried"), ((k * 37 % 101) / 8).alias("latency_s"),
    )


def run_report(spark, d):
    return E.summary(_run_rows(spark, d))


def embed_query(spark, d):
    v = dense.embed_questions(R.items(spark, d), "query_id")
    return v.select("query_id", F.array_join(F.transform("vector", lambda x: x.cast("long")), ",").alias("buckets"))


def embed_header(spark, d):
    header = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Title "), F.col("source"))).otherwise("")
    v = dense.embed_with_header(docs(spark, d).withColumn("header", header), "doc_id", "header")
    return v.select("doc_id", F.array_join(F.transform("vector", lambda x: x.cast("long")), ",").alias("buckets"))


def page_cascade(spark, d):
    """Engines' texts made of documents: plain text that some pages lack, a layout with symbols only on some, tables on a few."""
    k = F.col("doc_id")
    pages = docs(spark, d).select(
        F.col("source").alias("document_id"), (k % 130 + 1).alias("page_number"), k.alias("k"),
        F.when(k % 3 == 0, "").otherwise(F.col("text")).alias("plain"), F.when(k % 2 == 0, F.repeat(F.lit("#-"), 80)).otherwise(F.col("text")).alias("layout"),
        F.when(k % 10 == 1, "a | b").alias("tables"), F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("scan "), "text")).alias("scan"),
    )
    wide = pages.withColumn("plain", F.when(F.col("k") % 5 == 1, F.regexp_replace("plain", " ", "   ")).otherwise(F.col("plain")))
    out = X.page_texts(wide, "plain", "layout", "tables", "scan")
    return out.groupBy("document_id", "engine").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


def first_recognised(spark, d):
    k = F.col("doc_id")
    text = X.first_text(F.when(k % 2 == 0, "  ").otherwise(F.col("lang")), F.when(k % 3 > 0, F.col("source")), F.lit(None).cast("string"))
    return docs(spark, d).select("doc_id", text.alias("text"))


def registry_state(spark, d):
    """Events as registry operations: errors remove a user, the 40th event clears everything before it, all else is an upsert."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return Q.current(e, "user_id", "ts", "event_id", removed=F.col("event_type") == "error", cleared=F.col("event_id") == 40).select("user_id", "event_id", "value")


def reingest_plan(spark, d):
    """Documents as entries named by their text's first word; a third of the names come in again, under new ids and old ones."""
    e = docs(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("filename"))
    new = e.where("cast(document_id as long) % 3 = 0").select(F.when(F.col("document_id").cast("long") % 2 == 0, F.col("document_id")).otherwise(F.concat(F.lit("new"), "document_id")).alias("document_id"), "filename")
    return Q.replaced_by(e, new)


def registry_backfill(spark, d):
    chunks = docs(spark, d).select(F.when(F.col("doc_id") % 10 > 0, F.concat(F.lit("d"), F.expr("doc_id div 7").cast("string"))).alias("document_id"), F.col("source").alias("filename"), (F.col("doc_id") % 3).alias("page_number"))
    entries = docs(spark, d).where("doc_id % 2 = 0").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.concat(F.lit("file"), "doc_id").alias("filename"), F.lit(9).cast("long").alias("pages"), F.lit(99).cast("long").alias("chunks"))
    return Q.restored(entries, chunks)


def cooldown_wait(spark, d):
    e = table(spark, d, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("provider cooling down for "), F.round("value", 1).cast("string"), F.lit("s (quota)"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("cooling down ("), F.floor("value").cast("string"), F.lit("s left)")))
    return e.select("event_id", S.cooldown_wait(said.otherwise("timeout after 30s")).alias("wait_s"))


def quota_state(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    base = F.when(F.col("event_id") % 2 == 0, 60.0).otherwise(20.0)
    s = S.quota_state(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", base)
    return s.select("user_id", "failures", F.round("until", 3).alias("until"))


def quota_restore(spark, d):
    """A saved state per event, some of it broken, read back."""
    k = F.col("event_id")
    good = F.concat(F.lit('{"groq": {"until": '), (k % 90).cast("string"), F.lit('.5, "failures": '), (k % 4).cast("string"), F.lit('}, "bad": 7, "odd": {"until": "x"}, "bare": {}}'))
    saved = F.when(k % 5 == 0, F.lit("[1, 2]")).when(k % 5 == 1, F.lit("{not json")).otherwise(good)
    one = table(spark, d, "events").select("event_id", F.explode(S.sanitised(saved)).alias("provider", "s"))
    return one.select("event_id", "provider", "s.until", "s.failures")


def mc_sample(spark, d):
    """Forty items drawn by the seed."""
    return golden.sampled(docs(spark, d).select("doc_id", F.substring("text", 1, 60).alias("question")), 40, 7, "question", "doc_id").select("doc_id")


def single_document_items(spark, d):
    """Items about one source and the chunks of their gold pages."""
    i = R.items(spark, d).select(F.concat(F.lit("q"), "query_id").alias("id"), F.concat(F.lit("src"), (F.col("query_id") % 4).cast("string")).alias("source_file"), F.array((F.col("query_id") % 9).cast("int"), F.lit(11)).alias("source_pages"))
    chunks = docs(spark, d).select(F.col("source").alias("filename"), (F.col("doc_id") % 20).cast("int").alias("page_number"), "doc_id")
    return golden.about(i, "src1", chunks, gold_only=True)[1].select("id", "page_number", "doc_id")


QUERIES = {f.__name__: f for f in (
    refused_questions, unanswered_questions, raw_query_fallback, variant_dedupe, model_input, model_pages, prompt_assembly, rewrite_request, standalone_question, stream_materialise, answer_relevance,
    citation_metrics, run_report, embed_query, embed_header, page_cascade, first_recognised, registry_state, reingest_plan, registry_backfill, cooldown_wait, quota_state, quota_restore, mc_sample,
    single_document_items,
)}

_SCOPED = "q AS (SELECT item_id AS query_id, CASE WHEN item_id % 7 = 0 THEN '  ' ELSE text END AS text, CASE WHEN item_id % 3 > 0 THEN 'src' || item_id % 40 END AS scope FROM benchmark)"
_FIXED = redaction.fixed_sql("text")
_RANKED_FIXED = _RANKED.replace("text AS content", f"{_FIXED} AS content")
_NONE = A.NO_CONTEXT.replace("'", "''")
_T6 = lambda c: f"list_distinct(list_filter({tok(c)}, lambda t: length(t) >= 6))"
_FOLLOW = " OR ".join(f"starts_with(t, '{m}')" for m in D.FOLLOWUP)
_CITES = f"""f AS (SELECT * FROM ({R.first_k('scores', 10)})),
c AS (SELECT query_id, count_if(rank IN (1, 3, 9)) AS cited, count_if(rank IN (1, 3)) AS ok FROM f GROUP BY query_id HAVING cited > 0)"""
_ASCII = "regexp_replace(text, '[^ -~]', '?', 'g')"


_SQUASHED = r"regexp_replace(text, '\s+', ' ', 'g')"


def _share(x: str) -> str:
    return f"round_even({x}, 4)"


SQL = {
    "refused_questions": f"""
WITH {_SCOPED}, k AS (SELECT DISTINCT source FROM documents),
r AS (SELECT query_id, CASE WHEN {strip('text')} = '' THEN 'empty' WHEN length({strip('text')}) > 5000 THEN 'too_long' WHEN (SELECT count(*) FROM k) = 0 THEN '{A.NOTHING_UPLOADED}'
  WHEN scope IS NOT NULL AND scope NOT IN (SELECT source FROM k) THEN '{A.UNKNOWN_DOCUMENT}' END AS reason FROM q)
SELECT query_id, reason, '{_NONE}' AS answer FROM r WHERE reason IS NOT NULL""",
    "unanswered_questions": f"""
WITH {_SCOPED}, a AS (SELECT query_id, scope, unnest({_T6('text')}) AS w FROM q), h AS (SELECT DISTINCT source, unnest({_T6('text')}) AS w FROM documents)
SELECT query_id, CASE WHEN scope IS NULL THEN '' ELSE '{A.NO_MATCH_IN_DOCUMENT}' END AS reason, '{_NONE}' AS answer FROM q
WHERE query_id NOT IN (SELECT a.query_id FROM a JOIN h USING (w) WHERE scope IS NULL OR scope = source)""",
    "raw_query_fallback": f"""
WITH {R.bm25_ctes("SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'zzqx qqzz' ELSE text END AS text FROM benchmark", "a_").replace(" FROM a_terms JOIN a_freq USING (term) JOIN a_post USING (term), a_stats", " FROM a_terms JOIN a_freq USING (term) JOIN a_post USING (term), a_stats")},
{R.bm25_ctes(p="b_")}, x AS ({R.first_k('a_scores', 3)}), y AS ({R.first_k('b_scores', 3)})
SELECT *, 0 AS source FROM x UNION ALL SELECT *, 1 FROM y WHERE query_id NOT IN (SELECT query_id FROM x)""",
    "variant_dedupe": rf"""
WITH t AS (SELECT item_id AS query_id, translate(text, 'ß', 's') AS text FROM benchmark), w AS (SELECT query_id, text, string_split(text, ' ') AS w FROM t),
v AS (SELECT query_id, unnest(range(6)) AS variant, unnest([text, '  ' || upper(text) || ' ', array_to_string(w[1:3], ' '), array_to_string(w[1:1], ' ') || '   ' || array_to_string(w[2:3], ' '), ' ', array_to_string(w[2:5], ' ')]) AS text FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower({strip(_SQUASHED)}) ORDER BY variant) AS r FROM v WHERE {strip('text')} <> '')
SELECT query_id, variant::INT AS variant, md5(text) AS text_md5 FROM k WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY variant) <= 3""",
    "model_input": f"{_RANKED_FIXED} SELECT query_id, md5({_FIXED}) AS question_md5, md5(coalesce(context, '')) AS context_md5 FROM q LEFT JOIN ctx USING (query_id)",
    "model_pages": f"{_RANKED_FIXED} SELECT query_id, document_id, page_number, md5(string_agg(content, chr(10) ORDER BY rank)) AS text_md5 FROM ranked GROUP BY query_id, document_id, page_number",
    "prompt_assembly": f"""{_RANKED_FIXED}
SELECT query_id, 'Answer from the context.' || CASE WHEN query_id % 2 = 0 THEN '{A.SUMMARY.replace(chr(10), "' || chr(10) || '")}Topic ' || query_id ELSE '' END AS system,
  md5('Question: ' || {_FIXED} || chr(10) || chr(10) || 'Retrieved context:' || chr(10) || '<context>' || chr(10) || coalesce(context, '') || chr(10) || '</context>') AS prompt_md5 FROM q LEFT JOIN ctx USING (query_id)""",
    "rewrite_request": rf"""
WITH t AS (SELECT conv_id, turn, role, {_FIXED} AS text FROM conversations), l AS (SELECT conv_id, max(turn) AS z FROM t WHERE role = 'user' GROUP BY conv_id),
b AS (SELECT conv_id, turn, role, {strip('text')} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t JOIN l USING (conv_id) WHERE turn < z AND role IN ('user', 'assistant') AND {strip('text')} <> ''),
h AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || CASE WHEN length(s) <= 120 THEN s ELSE regexp_replace(substring(s, 1, 119), '\s+$', '') || '…' END, chr(10) ORDER BY turn) AS said
  FROM b WHERE back <= 4 GROUP BY conv_id)
SELECT conv_id, md5('Recent conversation:' || chr(10) || said || chr(10) || chr(10) || 'Follow-up question:' || chr(10) || text) AS request_md5 FROM t JOIN l USING (conv_id) JOIN h USING (conv_id) WHERE turn = z""",
    "standalone_question": rf"""
WITH a AS (SELECT conv_id, turn, {_ASCII} AS q FROM conversations), g AS (SELECT *, lower({strip('q')}) AS t, CASE WHEN {strip('q')} = '' THEN 0 ELSE len(string_split_regex({strip('q')}, '\s+')) END AS n FROM a)
SELECT conv_id, turn, md5(CASE WHEN (turn % 2 = 0 OR (t <> '' AND (n <= 6 OR {_FOLLOW}))) AND length(q) % 3 = 1 AND NOT contains(q, 'redacted') AND trim(substring(q, 1, 40), ' "') <> '' THEN {strip("regexp_replace(" + strip('substring(q, 1, 40)') + ", '^\"+|\"+$', '', 'g')")} ELSE q END) AS text_md5 FROM g""",
    "stream_materialise": """
SELECT conv_id * 100 + turn AS answer_id, md5(CASE WHEN cut THEN substring(text, 1, (n - 1) * 24) ELSE text END) AS text_md5, NOT cut AS complete
FROM (SELECT *, greatest(ceil(length(text) / 24), 1)::INT AS n, (conv_id * 100 + turn) % 5 = 0 AND ceil(length(text) / 24) > 1 AS cut FROM conversations)""",
    "answer_relevance": f"""
WITH {V._ANS}, u AS (SELECT conv_id, turn, 0 AS side, unnest({tok('answer')}) AS term FROM ans UNION ALL SELECT conv_id, turn, 1, unnest({tok('context')}) FROM ans),
v AS (SELECT conv_id, turn, side, ('0x' || substring(md5(term), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS n FROM u GROUP BY ALL),
s AS (SELECT conv_id, turn, sqrt(sum(n * n) FILTER (side = 0)) AS x, sqrt(sum(n * n) FILTER (side = 1)) AS y FROM v GROUP BY ALL), p AS (SELECT a.conv_id, a.turn, sum(a.n * e.n) AS dot FROM v a JOIN v e ON a.conv_id = e.conv_id AND a.turn = e.turn AND a.b = e.b AND a.side = 0 AND e.side = 1 GROUP BY ALL)
SELECT ans.conv_id, ans.turn, round(coalesce(dot / (x * y), 0), 4) AS answer_relevance FROM ans LEFT JOIN s USING (conv_id, turn) LEFT JOIN p USING (conv_id, turn)""",
    "citation_metrics": f"""{V._BM}, {_CITES}
SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 0 ELSE cited END AS cited_count, CASE WHEN query_id % 4 = 0 THEN 0 ELSE ok END AS cited_ok, CASE WHEN query_id % 4 > 0 THEN round_even(ok / cited, 4) END AS citation_precision FROM c""",
    "run_report": f"""{V._M}, {_CITES},
r AS (SELECT query_id AS k, m.*, CASE WHEN query_id % 5 IN (0, 2) THEN 0 ELSE cited END AS cc, CASE WHEN query_id % 5 IN (0, 2) THEN 0 ELSE ok END AS co FROM metrics m JOIN c USING (query_id))
SELECT count(*) AS items, {_share('count_if(k % 5 > 1) / count(*)')} AS answer_accuracy, {_share('count_if(k % 5 > 0) / count(*)')} AS answered_rate, {_share('count_if(k % 5 = 0) / count(*)')} AS no_context_rate,
  {', '.join(f"{_share(f'sum({c}) / count(*)')} AS {c}" for c in ('hit_at_k', 'recall_at_k', 'precision_at_k', 'ndcg_at_k', 'mrr_at_k'))}, {_share('sum(average_precision) / count(*)')} AS context_precision,
  {_share('sum(CASE WHEN k % 3 > 0 THEN recall_at_k ELSE 0 END) / count(*)')} AS context_recall, coalesce({_share('avg((k % 7) / 10) FILTER (k % 4 > 0)')}, 0) AS groundedness, coalesce({_share('avg((k % 3) / 4) FILTER (k % 4 > 0)')}, 0) AS ungrounded_fraction,
  {_share('avg((k % 9) / 8) FILTER (k % 2 = 0)')} AS answer_relevance, {_share('avg((k % 5) / 4) FILTER (k % 3 = 0 AND k % 2 > 0)')} AS nli_entailed_fraction, {_share('avg((k % 5) / 8) FILTER (k % 3 = 0 AND k % 2 > 0 AND k % 4 > 0)')} AS nli_contradiction_fraction,
  count_if(k % 3 = 0 AND k % 2 > 0) AS nli_rows_scored, {_share('count_if(k % 5 = 1) / count(*)')} AS pii_leak_rate, CASE WHEN sum(cc) > 0 THEN {_share('sum(co) / sum(cc)')} ELSE 0 END AS citation_support_rate,
  {_share('count_if(cc > 0) / greatest(count_if(k % 5 > 0), 1)')} AS citation_coverage, {_share('count_if(k % 6 > 4) / count(*)')} AS fallback_rate, round_even(median((k * 37 % 101) / 8), 3) AS median_e2e_s FROM r""",
    "embed_query": f"""WITH {R.bm25_ctes("SELECT item_id AS query_id, '" + dense.INSTRUCTION + "' || text AS text FROM benchmark")}, {R.dense_ctes()}
SELECT query_id, string_agg(n::BIGINT::VARCHAR, ',' ORDER BY b) AS buckets FROM (SELECT query_id, i.b, coalesce(v.n, 0) AS n FROM qn CROSS JOIN (SELECT unnest(range(64)) AS b) i LEFT JOIN qv v USING (query_id, b)) GROUP BY query_id""",
    "embed_header": f"""WITH {R.bm25_ctes("SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 THEN 'Title ' || source || chr(10) ELSE '' END || text AS text FROM documents WHERE trim(text) <> ''")}, {R.dense_ctes()}
SELECT query_id AS doc_id, string_agg(n::BIGINT::VARCHAR, ',' ORDER BY b) AS buckets FROM (SELECT query_id, i.b, coalesce(v.n, 0) AS n FROM qn CROSS JOIN (SELECT unnest(range(64)) AS b) i LEFT JOIN qv v USING (query_id, b)) GROUP BY query_id""",
    "page_cascade": rf"""
WITH p AS (SELECT source AS document_id, doc_id % 130 + 1 AS page_number, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 5 = 1 THEN replace(text, ' ', '   ') ELSE text END AS a, CASE WHEN doc_id % 2 = 0 THEN repeat('#-', 80) ELSE text END AS b,
  CASE WHEN doc_id % 10 = 1 THEN 'a | b' ELSE '' END AS c, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE 'scan ' || text END AS o FROM documents),
l AS (SELECT *, list_filter(list_transform(string_split(a, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM p WHERE page_number <= 100),
g AS (SELECT *, len(l) >= 2 AND len(list_filter(l, lambda x: len(string_split_regex(x, '\s{{2,}}')) >= 3)) >= greatest(2, CASE WHEN len(l) % 4 = 1 THEN (len(l) - 1) / 2 ELSE (len(l) + 1) // 2 END) AS tab,
  {', '.join(f"length({x}) >= 100 AND coalesce(length(regexp_replace({x}, '[^{chr(92)}p{{L}}{chr(92)}p{{N}}]', '', 'g')) / nullif(length(regexp_replace({x}, '{chr(92)}s', '', 'g')), 0) >= 0.5, FALSE) AS ok_{x}" for x in 'ab')} FROM l),
e AS (SELECT *, CASE WHEN tab AND c <> '' THEN 'tables' WHEN ok_a THEN 'text' WHEN ok_b THEN 'layout' WHEN {strip('o')} <> '' THEN 'ocr' ELSE 'none' END AS engine FROM g)
SELECT document_id, engine, count(*) AS pages, sum(CASE engine WHEN 'tables' THEN length(c) WHEN 'text' THEN length(a) WHEN 'layout' THEN length(b) WHEN 'ocr' THEN length(o) ELSE 0 END)::BIGINT AS chars FROM e GROUP BY document_id, engine""",
    "first_recognised": "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN lang WHEN doc_id % 3 > 0 THEN source ELSE '' END AS text FROM documents",
    "registry_state": """
WITH w AS (SELECT ts, event_id FROM events WHERE event_id = 40), s AS (SELECT * FROM events WHERE event_id <> 40 AND ((SELECT count(*) FROM w) = 0 OR (ts, event_id) > (SELECT (ts, event_id) FROM w)))
SELECT user_id, event_id, value FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'""",
    "reingest_plan": """
WITH e AS (SELECT doc_id, doc_id::VARCHAR AS document_id, source || '/' || doc_id % 50 AS filename FROM documents), n AS (SELECT CASE WHEN doc_id % 2 = 0 THEN document_id ELSE 'new' || document_id END AS by_, filename FROM e WHERE doc_id % 3 = 0)
SELECT DISTINCT e.document_id, n.by_ AS "by" FROM e JOIN n ON e.filename = n.filename OR e.document_id = n.by_""",
    "registry_backfill": """
WITH c AS (SELECT CASE WHEN doc_id % 10 > 0 THEN 'd' || doc_id // 7 END AS document_id, source, doc_id % 3 AS page FROM documents),
g AS (SELECT document_id, min(source) AS name, count(DISTINCT page) AS pages, count(*) AS chunks FROM c WHERE document_id IS NOT NULL GROUP BY document_id), r AS (SELECT 'd' || doc_id AS document_id, 'file' || doc_id AS filename FROM documents WHERE doc_id % 2 = 0)
SELECT g.document_id, coalesce(r.filename, g.name) AS filename, CASE WHEN r.filename IS NULL THEN g.pages ELSE 9 END AS pages, CASE WHEN r.filename IS NULL THEN g.chunks ELSE 99 END AS chunks, CASE WHEN r.filename IS NULL THEN 'backfilled' ELSE 'registry' END AS origin
FROM g LEFT JOIN r USING (document_id)""",
    "cooldown_wait": """
WITH w AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN round(value, 1) WHEN 1 THEN floor(value) END + 0.5 AS w FROM events) SELECT event_id, CASE WHEN w <= 60 THEN w END AS wait_s FROM w""",
    "quota_state": """
WITH i AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
f AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS failures FROM i),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, failures, round(CASE WHEN failures > 0 THEN epoch_us(ts) / 1e6 + least(900.0, CASE WHEN event_id % 2 = 0 THEN 60.0 ELSE 20.0 END * pow(2, least(failures, 40) - 1)) ELSE 0 END, 3) AS until FROM l""",
    "quota_restore": """
WITH g AS (SELECT event_id FROM events WHERE event_id % 5 > 1)
SELECT event_id, 'groq' AS provider, event_id % 90 + 0.5::DOUBLE AS until, (event_id % 4)::INT AS failures FROM g UNION ALL SELECT event_id, 'bare', 0.0, 0 FROM g""",
    "mc_sample": "SELECT doc_id FROM documents ORDER BY md5('7:' || substring(text, 1, 60)), substring(text, 1, 60), doc_id LIMIT 40",
    "single_document_items": """
WITH i AS (SELECT 'q' || item_id AS id, unnest([item_id % 9, 11]) AS page_number FROM benchmark WHERE item_id % 4 = 1)
SELECT i.id, i.page_number::INT AS page_number, d.doc_id FROM i JOIN documents d ON d.source = 'src1' AND d.doc_id % 20 = i.page_number""",
}
SQL["raw_query_fallback"] = typed(SQL["raw_query_fallback"], rank="INTEGER")
SQL["citation_metrics"] = typed(SQL["citation_metrics"], cited_count="BIGINT", cited_ok="BIGINT")
SQL["run_report"] = typed(SQL["run_report"], **{c: "DOUBLE" for c in ("precision_at_k", "recall_at_k", "groundedness", "ungrounded_fraction", "citation_support_rate", "citation_coverage", "context_precision", "context_recall", "median_e2e_s")}, nli_rows_scored="BIGINT")
