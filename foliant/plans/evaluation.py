"""Queries of evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import dialogue as D
from foliant.operators import evaluate as E
from foliant.operators.fusion import overlap_f1
from foliant.plans import retrieval as R
from foliant.plans.text import claims, mtok, squash, tok, typed, values
from foliant.sources import golden
from foliant.sources.scratch import written
from foliant.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents")


def metrics(spark, d):
    gold = written(gold_pairs(spark, d), "gold")  # read twice; found in one pass over the texts
    return E.ranking(R.best(spark, d), gold)


def _metric(name):
    def query(spark, d):
        return metrics(spark, d).select("query_id", name)

    query.__name__ = name
    return query


METRICS = ("hit_at_k", "precision_at_k", "recall_at_k", "mrr_at_k", "ndcg_at_k", "average_precision", "first_hit")


def gold_pairs(spark, d):
    return E.containment(docs(spark, d), R.items(spark, d), R.index(spark, d))


def retrieval_gap(spark, d):
    """Mean recall of hybrid minus sparse ranking."""
    gold = gold_pairs(spark, d)
    a = E.ranking(R.hybrid(spark, d), gold).agg(F.avg("recall_at_k").alias("a"))
    b = metrics(spark, d).agg(F.avg("recall_at_k").alias("b"))
    return a.withColumn("b", b.scalar()).select(F.round(F.col("a") - F.col("b"), 5).alias("gap"))


def context_recall(spark, d):
    """First and last words of an item, and a phrase that no text has, as points; the five best documents as context."""
    found = R.best(spark, d, 5).join(docs(spark, d).select("doc_id", "text"), "doc_id")
    context = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x")).select("query_id", F.array_join(F.transform("x", lambda v: v["text"]), "\n").alias("context"))
    words = F.split("text", " ")
    points = F.array(F.array_join(F.slice(words, 1, 4), "  "), F.array_join(F.slice(F.reverse(words), 1, 3), " "), F.lit("no such phrase"), F.lit(""))
    return R.items(spark, d).join(context, "query_id").select("query_id", F.round(E.points_found(points, F.col("context")) / 4, 6).alias("context_recall"))


def grade_answers(spark, d):
    """Answers graded against words of the turn before: grouped facts, any of some points, an expected answer, or a refusal."""
    w = F.split("context", " ")
    at = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit("zz"))
    k = F.col("conv_id") + F.col("turn")
    r = _answers(spark, d).withColumn("k", k).withColumn("answer", F.when(k % 5 == 4, F.concat("answer", F.lit(" This is not mentioned anywhere."))).when(k % 11 == 0, " ").otherwise(F.concat("answer", F.lit("  "), F.upper(F.translate(at(0), "ß", "s")))))
    groups = F.when(k % 5 == 0, F.array(F.array(at(0), F.lit("qq")), F.array(at(1), at(2)))).when(k % 5 == 1, F.array(F.array(at(0))))
    points = F.when(k % 5 == 2, F.array(at(3), at(4))).when(k % 5 == 4, F.array(F.lit("x y z")))
    expected = F.when(k % 5 == 3, at(0))
    declines = (F.col("k") % 10 == 4) & D.refuses(F.col("answer"))
    return r.select("conv_id", "turn", E.graded(F.col("answer"), groups, points, expected, declines).alias("correct"))


def _answers(spark, d):
    """Turns as answers, with the turn before as context."""
    t = table(spark, d, "conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("answer"), "context")


def token_f1(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.round(overlap_f1(T.metric_tokens("answer"), T.metric_tokens("context")), 6).alias("f1"))


def claim_support(spark, d):
    s = _answers(spark, d).select("conv_id", "turn", F.posexplode(E.supports(F.col("answer"), F.col("context"))).alias("n", "s"))
    return s.select("conv_id", "turn", "n", F.round("s", 6).alias("support"))


def groundedness(spark, d):
    return E.groundedness(_answers(spark, d), "answer", "context").select("conv_id", "turn", "claims", "groundedness", "ungrounded_fraction")


def _cited(spark, d):
    """Answers that cite ranks 1, 3 and 9 of their question; what was retrieved is the first five."""
    found = R.best(spark, d).join(docs(spark, d).select("doc_id", "source"), "doc_id")
    cite = F.concat(F.lit("(files/"), F.upper("source"), F.lit(".txt, p."), F.col("doc_id").cast("string"), F.lit(")"))
    said = found.where("rank in (1, 3, 9)").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", cite.alias("c")))).alias("x"))
    said = said.select("query_id", F.array_join(F.transform("x", lambda v: v["c"]), " and ").alias("answer"))
    refs = found.where("rank <= 5").select("query_id", F.concat("source", F.lit(".txt")).alias("document"), F.col("doc_id").cast("int").alias("page"))
    return said, refs


def citation_support(spark, d):
    said, refs = _cited(spark, d)
    cited = said.select("query_id", F.explode(T.citations("answer")).alias("c")).select("query_id", "c.document", "c.page")
    ok = cited.join(refs.distinct().withColumn("_ok", F.lit(1)), ["query_id", "document", "page"], "left")
    return ok.groupBy("query_id").agg(F.count("*").alias("cited"), F.count("_ok").alias("supported"))


def nli_verdicts(spark, d):
    """Four vectors as a claim's contexts, their first components as logits."""
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("claim"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 8).alias("logits"))
    return E.nli(e)


def nli_summary(spark, d):
    v = nli_verdicts(spark, d)
    return v.agg(F.count("*").alias("claims"), F.bround(F.avg(F.col("entailed").cast("double")), 4).alias("entailed"), F.bround(F.avg(F.col("contradicted").cast("double")), 4).alias("contradicted"))


def _graded(spark, d):
    return table(spark, d, "labels").join(docs(spark, d), "doc_id")


def accuracy_breakdown(spark, d):
    return E.accuracy(_graded(spark, d), "lang", F.col("quality") == 1).withColumnRenamed("lang", "key")


def run_summary(spark, d):
    """One row of measures with their different denominators: missing scores count as 0 in one mean and are left out of another."""
    r = _graded(spark, d)
    score = F.when(F.col("toxic") == 0, F.length("text") / 1000.0)
    no_context = F.length("text") < 60
    answered = F.count("*") - F.count_if(no_context)
    return r.agg(
        F.count("*").alias("items"),
        F.bround(F.avg((F.col("quality") == 1).cast("double")), 4).alias("accuracy"),
        F.bround(answered / F.count("*"), 4).alias("answered_rate"),
        F.bround(F.sum(F.coalesce(score, F.lit(0.0))) / F.count("*"), 4).alias("mean_with_zeros"),
        F.bround(F.avg(score), 4).alias("mean_of_scored"),
        F.round(F.median(F.length("text")), 3).alias("median_chars"),
        F.bround(F.count_if(F.col("toxic") == 1) / F.greatest(answered, F.lit(1)), 4).alias("coverage"),
    )


def metric_grouping_sets(spark, d):
    """Means overall, per language and per source in one pass; scores that are no numbers are left out."""
    _graded(spark, d).withColumn("score", F.when(F.col("toxic") == 1, F.lit(float("nan"))).otherwise(F.col("quality").cast("double"))).createOrReplaceTempView("graded_rows")
    return spark.sql("""SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS level, coalesce(lang, source, 'all') AS key,
      count_if(NOT isnan(score)) AS n, bround(avg(nullif(score, double('nan'))), 4) AS mean FROM graded_rows GROUP BY GROUPING SETS ((), (lang), (source))""")


def upper_median(spark, d):
    """The upper of the two middle values."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC)").alias("upper_median"))


PRICES = (("click", 0.5, 1.5), ("purchase", 2.0, 6.0), ("view", 0.1, 0.3))


def _calls(spark, d):
    calls = table(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("provider"), F.floor(F.col("value") * 10).alias("prompt_tokens"), F.floor(F.col("value")).alias("completion_tokens"))
    return E.cost(calls, spark.createDataFrame([list(p) for p in PRICES], "provider string, p double, c double"), (1.0, 1.0))


def cost_by_provider(spark, d):
    return _calls(spark, d).groupBy("provider").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost"), 7).alias("cost_usd")
    )


def cost_delta(spark, d):
    """What the second half of January added."""
    c = _calls(spark, d)
    snap = lambda x, s: x.groupBy("provider").agg(F.count("*").alias(f"calls{s}"), F.sum("cost").alias(f"cost{s}"))
    both = snap(c, "").join(snap(c.where("ts < timestamp'2024-01-16'"), "_before"), "provider", "left")
    return both.select("provider", (F.col("calls") - F.coalesce("calls_before", F.lit(0))).alias("calls"), F.round(F.col("cost") - F.coalesce("cost_before", F.lit(0.0)), 7).alias("cost_usd"))


def budget_cutoff(spark, d):
    return E.within_budget(_calls(spark, d), "user_id", ["ts", "event_id"], 0.01).select("event_id", "user_id", F.round("spent", 7).alias("spent"))


def golden_join(spark, d):
    """Answers meet their references by prefixed id."""
    refs = R.items(spark, d).select(F.concat(F.lit("d01_q"), F.col("query_id").cast("string")).alias("id"), F.col("text").alias("reference"))
    rows = docs(spark, d).select(F.concat(F.lit("d01_q"), F.col("doc_id").cast("string")).alias("id"), "lang")
    return rows.join(refs, "id").select("id", "lang", F.md5("reference").alias("reference_md5"))


def _runs(spark, d):
    l = table(spark, d, "labels")
    prior = l.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("quality")).alias("a"), F.col("toxic").alias("b"))
    fresh = l.where("doc_id % 3 <> 1").select("doc_id", (F.col("quality") + 10).alias("a"), F.when(F.col("doc_id") % 5 == 0, F.lit(7)).alias("b"))
    return prior, fresh


def resume_merge(spark, d):
    return E.merged(*_runs(spark, d), "doc_id", ["a", "b"])


def resume_pending(spark, d):
    return E.pending(table(spark, d, "labels"), _runs(spark, d)[0], "doc_id").select("doc_id")


def token_jaccard_setops(spark, d):
    """Shared and all tokens of each answer and its context."""
    a, b = F.array_distinct(T.tokens("answer")), F.array_distinct(T.tokens("context"))
    return _answers(spark, d).select("conv_id", "turn", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("all"), F.size(F.array_except(a, b)).alias("only_answer"))


def _golden(spark, d):
    """Questions of each document as a JSON file: a list for even ids, an object with questions for odd ones."""
    k = F.col("doc_id")
    one = F.struct(
        F.concat(F.lit("q"), k.cast("string")).alias("id"), F.when(k % 4 > 0, F.get(F.array(F.lit("direct"), F.lit("comparison"), F.lit("numerical")), (k % 3).cast("int"))).alias("category"),
        F.concat(F.lit("Is it \""), F.substring("text", 1, 10), F.lit("\"?")).alias("question"), F.when(k % 3 > 0, F.array((k % 7).cast("int"), F.lit(2))).alias("source_pages"),
        F.when(k % 5 == 0, F.array(F.array("lang", "source"), F.array("lang"))).alias("required_fact_groups"),
    )
    payload = F.when(k % 2 == 0, F.to_json(F.array(one))).otherwise(F.to_json(F.struct(F.array(one).alias("questions"))))
    rows = docs(spark, d).select(payload.alias("payload"), F.concat(F.lit("d"), F.lpad((k % 3).cast("string"), 2, "0")).alias("tag"), F.concat("source", F.lit(".pdf")).alias("file"))
    return rows.select(F.explode(golden.items_of(F.col("payload"), F.col("tag"), F.col("file"))).alias("i")).select("i.*")


def golden_items(spark, d):
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return _golden(spark, d).select("id", "category", "question", "source_file", size(F.coalesce("source_pages", F.array().cast("array<int>"))).alias("n_pages"), size(F.coalesce("required_fact_groups", F.array().cast("array<array<string>>"))).alias("n_groups"))


def oracle_retrieval(spark, d):
    """Gold pages as context: items' source pages opened and joined to the pages of their file."""
    i = _golden(spark, d).select("id", "source_file", F.explode("source_pages").alias("page_number"))
    pages = docs(spark, d).select(F.concat("source", F.lit(".pdf")).alias("source_file"), (F.col("doc_id") % 7).cast("int").alias("page_number"), "doc_id", F.length("text").alias("chars"))
    return golden.opened(i, pages, ["source_file", "page_number"]).select("id", "page_number", "doc_id", "chars")


def mc_accuracy(spark, d):
    """Multiple-choice items of both shapes made of documents, answered and scored per category; unusable ones are left out."""
    k = F.col("doc_id")
    listed = F.to_json(F.struct(F.concat(F.lit("Which "), k.cast("string")).alias("question"), F.col("lang").alias("category"), F.struct(F.array("source", F.lit("none"), "lang").alias("choices"), (k % 3).cast("int").alias("label")).alias("mc1_targets")))
    named = F.to_json(F.struct(F.when(k % 7 > 0, F.lit("What")).otherwise("").alias("question"), F.col("lang").alias("category"), F.col("source").alias("best_answer"), F.array(F.lit("w"), F.lit(" "), "source", "lang").alias("incorrect_answers")))
    bare = F.to_json(F.struct(F.lit("Why").alias("question"), F.col("lang").alias("category"), F.col("source").alias("best_answer"), F.array(F.lit("")).alias("incorrect_answers")))
    record = F.when(k % 3 == 0, listed).when(k % 3 == 1, named).otherwise(F.when(k % 2 == 0, bare).otherwise(named))
    reply = F.when(k % 5 == 0, "no idea").otherwise(F.concat(F.lit("Answer: "), F.char((F.lit(65) + k % 4).cast("int"))))
    m = docs(spark, d).select(golden.choices_of(record).alias("m"), reply.alias("reply")).where("m is not null").withColumn("choice", T.choice("reply", "m.choices"))
    return m.groupBy(F.col("m.category").alias("category")).agg(F.count("*").alias("items"), F.count("choice").alias("answered"), F.count_if(F.col("choice") == F.col("m.label")).alias("correct"))


def usage_parse(spark, d):
    """Replies of both providers' shapes made of events, some without a total, some without usage."""
    k = F.col("event_id")
    n = lambda m: (k % m).cast("string")
    one = F.concat(F.lit('{"usage": {"prompt_tokens": '), n(900), F.lit(', "completion_tokens": '), n(70), F.when(k % 2 == 0, F.concat(F.lit(', "total_tokens": '), n(1000))).otherwise(""), F.lit("}}"))
    two = F.concat(F.lit('{"usageMetadata": {"promptTokenCount": '), n(800), F.lit(', "candidatesTokenCount": '), n(60), F.lit("}}"))
    u = E.usage(F.when(k % 3 == 0, one).when(k % 3 == 1, two).otherwise(F.concat(F.lit('{"x": '), n(5), F.lit("}"))))
    return table(spark, d, "events").select("event_id", u["prompt_tokens"].alias("prompt_tokens"), u["completion_tokens"].alias("completion_tokens"), u["total_tokens"].alias("total_tokens"))


QUERIES = {m: _metric(m) for m in METRICS} | {f.__name__: f for f in (
    gold_pairs, retrieval_gap, context_recall, grade_answers, token_f1, claim_support, groundedness, citation_support, nli_verdicts, nli_summary, accuracy_breakdown, run_summary,
    metric_grouping_sets, upper_median, cost_by_provider, cost_delta, budget_cutoff, golden_join, resume_merge, resume_pending, token_jaccard_setops, golden_items, oracle_retrieval,
    mc_accuracy, usage_parse,
)}

_GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def metrics_sql(ranked: str) -> str:
    return f"""
m AS (SELECT r.query_id, r.rank, g.doc_id IS NOT NULL AS hit, sum((g.doc_id IS NOT NULL)::INT) OVER (PARTITION BY r.query_id ORDER BY r.rank) AS i FROM ({ranked}) r LEFT JOIN gold g USING (query_id, doc_id)),
x AS (SELECT query_id, count_if(hit AND rank <= 10) AS hits, count_if(hit) AS listed, min(rank) FILTER (hit AND rank <= 10) AS first_hit, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 10), 0) AS dcg,
  coalesce(sum(i / rank) FILTER (hit AND rank <= 10), 0) AS ap FROM m GROUP BY query_id),
y AS (SELECT x.*, (SELECT count(*) FROM gold g WHERE g.query_id = x.query_id) AS relevant, list_sum(list_transform(range(1, (least(10, listed) + 1)::BIGINT), lambda i: 1 / log2(i + 1))) AS ideal FROM x),
metrics AS (SELECT query_id, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_at_k, round(hits / 10, 6) AS precision_at_k, CASE WHEN relevant > 0 THEN round(hits / relevant, 6) ELSE 0 END AS recall_at_k,
  coalesce(round(1 / first_hit, 6), 0) AS mrr_at_k, CASE WHEN ideal > 0 THEN round(dcg / ideal, 6) ELSE 0 END AS ndcg_at_k, CASE WHEN relevant > 0 THEN round(ap / relevant, 6) ELSE 0 END AS average_precision, first_hit FROM y)"""


_BM = f"WITH {R.bm25_ctes()}"
_M = f"{_BM}, {_GOLD}, {metrics_sql(R.first_k('scores', 10))}"
_ANS = "ans AS (SELECT t.conv_id, t.turn, t.text AS answer, b.text AS context FROM conversations t JOIN conversations b ON b.conv_id = t.conv_id AND b.turn + 1 = t.turn)"


def f1_sql(pairs: str, key: str) -> str:
    """F1 of token lists a and b of ``pairs(key..., a, b)``: CTE f1(key..., f1)."""
    return f"""
fp AS ({pairs}),
fa AS (SELECT {key}, t, count(*) AS cnt FROM (SELECT {key}, unnest(a) AS t FROM fp) GROUP BY ALL),
fb AS (SELECT {key}, t, count(*) AS cnt FROM (SELECT {key}, unnest(b) AS t FROM fp) GROUP BY ALL),
fc AS (SELECT {key}, sum(least(fa.cnt, fb.cnt))::DOUBLE AS c FROM fa JOIN fb USING ({key}, t) GROUP BY ALL),
f1 AS (SELECT {', '.join('fp.' + k.strip() for k in key.split(','))}, coalesce(2 * (c / len(a)) * (c / len(b)) / (c / len(a) + c / len(b)), 0) AS f1 FROM fp LEFT JOIN fc USING ({key}))"""


_CLAIMS = f"""{_ANS},
cl AS (SELECT conv_id, turn, unnest(range(len(c))) AS n, unnest(c) AS claim FROM (SELECT conv_id, turn, {claims('answer')} AS c FROM ans)),
se AS (SELECT conv_id, turn, unnest(range(len(c))) AS s, unnest(c) AS sentence FROM (SELECT conv_id, turn, {claims('context')} AS c FROM ans)),
{f1_sql(f"SELECT conv_id, turn, n, s, {mtok('claim')} AS a, {mtok('sentence')} AS b FROM cl JOIN se USING (conv_id, turn)", 'conv_id, turn, n, s')},
su AS (SELECT conv_id, turn, n, coalesce(max(f1), 0) AS support FROM cl LEFT JOIN f1 USING (conv_id, turn, n) GROUP BY ALL)"""
_GOLDEN = """golden AS (SELECT doc_id, 'd0' || doc_id % 3 || '_q' || doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE (['direct_fact_lookup', 'comparison', 'numerical_financial'])[doc_id % 3 + 1] END AS category,
  'Is it "' || substring(text, 1, 10) || '"?' AS question, source || '.pdf' AS source_file FROM documents)"""
_G = "graded AS (SELECT * FROM labels JOIN documents USING (doc_id))"
_NLI = """z AS (SELECT vec_id // 4 AS claim, list_transform(embedding[1:3]::DOUBLE[], lambda x: x * 8) AS a FROM embeddings), ez AS (SELECT claim, list_transform(a, lambda v: exp(v - list_max(a))) AS a FROM z),
bz AS (SELECT claim, max(a[2] / list_sum(a)) AS ent, max(a[1] / list_sum(a)) AS con FROM ez GROUP BY claim),
v AS (SELECT claim, round(ent, 6) AS entailment, round(con, 6) AS contradiction, ent >= 0.5 AND ent >= con AS entailed, NOT (ent >= 0.5 AND ent >= con) AND con >= 0.5 AS contradicted FROM bz)"""
_COST = f"""calls AS (SELECT event_id, user_id, ts, event_type AS provider, floor(value * 10)::BIGINT AS pt, floor(value)::BIGINT AS ct FROM events),
priced AS (SELECT c.*, (pt * coalesce(p, 1.0)::DOUBLE + ct * coalesce(c_, 1.0)::DOUBLE) / 1e6 AS cost FROM calls c LEFT JOIN {values(PRICES, 'provider, p, c_')} USING (provider))"""

SQL = {m: f"{_M} SELECT query_id, {m} FROM metrics" for m in METRICS} | {
    "gold_pairs": f"WITH {_GOLD} SELECT * FROM gold",
    "retrieval_gap": f"""{_BM}, {R.dense_ctes()}, {_GOLD}, hyb AS ({R.rrf_sql([(R.first_k('near', 10), 0.5), (R.first_k('scores', 10), 0.5)])}),
rec AS (SELECT list, avg(CASE WHEN rel > 0 THEN round(hits / rel, 6) ELSE 0 END) AS r FROM (
  SELECT l.list, l.query_id, count(g.doc_id) AS hits, (SELECT count(*) FROM gold g2 WHERE g2.query_id = l.query_id) AS rel
  FROM (SELECT 'h' AS list, query_id, doc_id FROM hyb WHERE rank <= 10 UNION ALL SELECT 's', query_id, doc_id FROM ({R.first_k('scores', 10)})) l LEFT JOIN gold g USING (query_id, doc_id) GROUP BY l.list, l.query_id) GROUP BY list)
SELECT round((SELECT r FROM rec WHERE list = 'h') - (SELECT r FROM rec WHERE list = 's'), 5) AS gap""",
    "context_recall": f"""{_BM}, ctx AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context FROM ({R.first_k('scores', 5)}) JOIN documents USING (doc_id) GROUP BY query_id),
p AS (SELECT query_id, [array_to_string(string_split(text, ' ')[1:4], '  '), array_to_string(list_reverse(string_split(text, ' '))[1:3], ' '), 'no such phrase', ''] AS points FROM q)
SELECT query_id, round(len(list_filter(points, lambda x: {squash('x')} <> '' AND contains({squash('context')}, {squash('x')}))) / 4, 6) AS context_recall FROM p JOIN ctx USING (query_id)""",
    "grade_answers": f"""
WITH {_ANS}, w AS (SELECT *, conv_id + turn AS k, string_split(context, ' ') AS w FROM ans), v AS (SELECT *, [coalesce(w[i], 'zz') for i in [1, 2, 3, 4, 5]] AS p FROM w),
g AS (SELECT conv_id, turn, k, {squash("CASE WHEN k % 5 = 4 THEN answer || ' This is not mentioned anywhere.' WHEN k % 11 = 0 THEN ' ' ELSE answer || '  ' || upper(translate(p[1], 'ß', 's')) END")} AS t,
  CASE k % 5 WHEN 0 THEN [[p[1], 'qq'], [p[2], p[3]]] WHEN 1 THEN [[p[1]]] END AS grps, CASE k % 5 WHEN 2 THEN [p[4], p[5]] WHEN 4 THEN ['x y z'] END AS points, CASE WHEN k % 5 = 3 THEN p[1] END AS expected FROM v)
SELECT conv_id, turn, t <> '' AND CASE WHEN len(coalesce(grps, [])) > 0 THEN len(list_filter(grps, lambda g: len(list_filter(g, lambda x: {squash('x')} <> '' AND contains(t, {squash('x')}))) > 0)) = len(grps)
  ELSE len(list_filter(list_concat(coalesce(points, []), CASE WHEN expected IS NULL THEN [] ELSE [expected] END), lambda x: {squash('x')} <> '' AND contains(t, {squash('x')}))) > 0
    OR (k % 10 = 4 AND ({' OR '.join(f"contains(t, '{m}')" for m in D.REFUSALS)})) END AS correct FROM g""",
    "token_f1": f"WITH {_ANS}, {f1_sql(f"SELECT conv_id, turn, {mtok('answer')} AS a, {mtok('context')} AS b FROM ans", 'conv_id, turn')} SELECT conv_id, turn, round(f1, 6) AS f1 FROM f1",
    "claim_support": f"WITH {_CLAIMS} SELECT conv_id, turn, n::INT AS n, round(support, 6) AS support FROM su",
    "groundedness": f"""WITH {_CLAIMS} SELECT conv_id, turn, count(n)::INT AS claims, round(coalesce(avg(support), 0), 6) AS groundedness, round(coalesce(avg((support < 0.3)::INT) , 0), 6) AS ungrounded_fraction
FROM ans LEFT JOIN su USING (conv_id, turn) GROUP BY conv_id, turn""",
    "citation_support": f"""{_BM}, f AS (SELECT * FROM ({R.first_k('scores', 10)}))
SELECT query_id, count_if(rank IN (1, 3, 9)) AS cited, count_if(rank IN (1, 3)) AS supported FROM f GROUP BY query_id HAVING cited > 0""",
    "nli_verdicts": f"WITH {_NLI} SELECT * FROM v",
    "nli_summary": f"WITH {_NLI} SELECT count(*) AS claims, round_even(avg(entailed::INT), 4) AS entailed, round_even(avg(contradicted::INT), 4) AS contradicted FROM v",
    "accuracy_breakdown": f"WITH {_G} SELECT lang AS key, count(*) AS n, count_if(quality = 1) AS correct, round_even(avg((quality = 1)::INT), 4) AS accuracy FROM graded GROUP BY lang",
    "run_summary": f"""WITH {_G} SELECT count(*) AS items, round_even(avg((quality = 1)::INT), 4) AS accuracy, round_even(count_if(length(text) >= 60) / count(*), 4) AS answered_rate,
  round_even(sum(CASE WHEN toxic = 0 THEN length(text) / 1000 ELSE 0 END) / count(*), 4) AS mean_with_zeros, round_even(avg(CASE WHEN toxic = 0 THEN length(text) / 1000 END), 4) AS mean_of_scored,
  round(median(length(text))::DOUBLE, 3) AS median_chars, round_even(count_if(toxic = 1) / greatest(count_if(length(text) >= 60), 1), 4) AS coverage FROM graded""",
    "metric_grouping_sets": f"""WITH {_G} SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS level, coalesce(lang, source, 'all') AS key,
  count_if(toxic <> 1) AS n, round_even(avg(quality) FILTER (toxic <> 1), 4) AS mean FROM graded GROUP BY GROUPING SETS ((), (lang), (source))""",
    "upper_median": "SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS upper_median FROM events GROUP BY event_type",
    "cost_by_provider": f"WITH {_COST} SELECT provider, count(*) AS calls, sum(pt)::BIGINT AS prompt_tokens, sum(ct)::BIGINT AS completion_tokens, round(sum(cost), 7) AS cost_usd FROM priced GROUP BY provider",
    "cost_delta": f"WITH {_COST} SELECT provider, count_if(ts >= TIMESTAMP '2024-01-16') AS calls, round(coalesce(sum(cost) FILTER (ts >= TIMESTAMP '2024-01-16'), 0), 7) AS cost_usd FROM priced GROUP BY provider",
    "budget_cutoff": f"""WITH {_COST}, s AS (SELECT event_id, user_id, round(sum(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS spent FROM priced)
SELECT event_id, user_id, round(spent, 7) AS spent FROM s WHERE spent <= 0.01::DOUBLE""",
    "golden_join": "SELECT 'd01_q' || doc_id AS id, lang, md5(b.text) AS reference_md5 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id",
    "resume_merge": """
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN quality END AS a, toxic AS b FROM labels WHERE doc_id % 3 <> 0), f AS (SELECT doc_id, quality + 10 AS a, CASE WHEN doc_id % 5 = 0 THEN 7 END AS b FROM labels WHERE doc_id % 3 <> 1)
SELECT coalesce(f.doc_id, p.doc_id) AS doc_id, coalesce(f.a, p.a) AS a, coalesce(f.b, p.b) AS b FROM p FULL JOIN f ON p.doc_id = f.doc_id""",
    "resume_pending": "SELECT doc_id FROM labels WHERE doc_id % 3 = 0",
    "token_jaccard_setops": f"""WITH {_ANS}, t AS (SELECT conv_id, turn, list_distinct({tok('answer')}) AS a, list_distinct({tok('context')}) AS b FROM ans)
SELECT conv_id, turn, len(list_intersect(a, b))::INT AS shared, len(list_distinct(list_concat(a, b)))::INT AS "all", len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS only_answer FROM t""",
    "golden_items": f"WITH {_GOLDEN} SELECT id, category, question, source_file, CASE WHEN doc_id % 3 > 0 THEN 2 ELSE 0 END AS n_pages, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS n_groups FROM golden",
    "oracle_retrieval": f"""WITH {_GOLDEN}, i AS (SELECT id, source_file, unnest([doc_id % 7, 2]) AS page FROM golden WHERE doc_id % 3 > 0)
SELECT id, page::INT AS page_number, d.doc_id, length(text)::INT AS chars FROM i JOIN documents d ON d.source || '.pdf' = source_file AND d.doc_id % 7 = page""",
    "mc_accuracy": """
WITH m AS (SELECT doc_id AS k, lang, CASE WHEN doc_id % 3 = 0 THEN 3 WHEN doc_id % 3 = 2 AND doc_id % 2 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN 0 ELSE 3 END AS n, CASE WHEN doc_id % 3 = 0 THEN doc_id % 3 ELSE 0 END AS label,
  CASE WHEN doc_id % 5 > 0 THEN doc_id % 4 END AS said FROM documents)
SELECT lang AS category, count(*) AS items, count(CASE WHEN said < n THEN said END) AS answered, count_if(said < n AND said = label) AS correct FROM m WHERE n > 0 GROUP BY lang""",
    "usage_parse": """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 900 WHEN 1 THEN event_id % 800 ELSE 0 END::INT AS prompt_tokens, CASE event_id % 3 WHEN 0 THEN event_id % 70 WHEN 1 THEN event_id % 60 ELSE 0 END::INT AS completion_tokens,
  CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN event_id % 1000 ELSE event_id % 900 + event_id % 70 END WHEN 1 THEN event_id % 800 + event_id % 60 ELSE 0 END::INT AS total_tokens FROM events""",
}
SQL["first_hit"] = typed(SQL["first_hit"], first_hit="INTEGER")
SQL["citation_support"] = typed(SQL["citation_support"], cited="BIGINT", supported="BIGINT")
SQL["accuracy_breakdown"] = typed(SQL["accuracy_breakdown"], correct="BIGINT")
SQL["metric_grouping_sets"] = typed(SQL["metric_grouping_sets"], n="BIGINT")
SQL["cost_delta"] = typed(SQL["cost_delta"], calls="BIGINT")
SQL["mc_accuracy"] = typed(SQL["mc_accuracy"], items="BIGINT", answered="BIGINT", correct="BIGINT")
