"""Ranking, grounding and run metrics over tables of results."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from foliant.functions.text import citations, claims, cosine, metric_tokens, softmax, squash, tokens
from foliant.operators.bm25 import Index, build
from foliant.operators.fusion import f1
from foliant.sources.scratch import written

UNGROUNDED = 0.3


def containment(documents: DataFrame, items: DataFrame, index: Index | None = None) -> DataFrame:
    """query_id, doc_id: documents that hold an item's text verbatim; ``index`` is theirs, if there is one.

    Candidates come from the item's rarest inner token (one equal-key join), so no
    pair without a shared token is looked at.  Items of fewer than three tokens
    have no inner token; their patterns go over every text in blocks of ``SHORT_ITEMS``."""
    short = F.size(_inner("text")) == 0
    return _by_token(documents, items.where(~short), index).unionByName(_by_scan(documents, items.where(short & (F.col("text") != ""))))


#: Items without an inner token that one pass over the texts looks for.
SHORT_ITEMS = 256


def _by_scan(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Short items against all texts: each block of items stands in one array, and each text filters the array."""
    blocks = items.withColumn("_b", F.expr(f"(row_number() over (partition by pmod(hash(query_id), 64) order by query_id) - 1) div {SHORT_ITEMS}"))
    blocks = blocks.groupBy(F.expr("pmod(hash(query_id), 64)").alias("_h"), "_b").agg(F.collect_list(F.struct("query_id", "text")).alias("_items"))
    held = documents.select("doc_id", "text").join(blocks, F.lit(True))
    hit = F.filter("_items", lambda i: F.contains(F.col("text"), i["text"]))
    return held.select("doc_id", F.explode(hit).alias("_i")).select("_i.query_id", "doc_id")


def _by_token(documents: DataFrame, items: DataFrame, index: Index | None) -> DataFrame:
    terms = items.select("query_id", F.explode(F.array_distinct(_inner("text"))).alias("term"))
    posted, df = (index or build(documents)).of_terms(terms.select("term").distinct())
    rare = terms.join(df, "term").groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("t")).select("query_id", F.col("t.term").alias("term"))
    sought = rare.join(items.select("query_id", F.col("text").alias("_item")), "query_id").groupBy("term").agg(F.collect_list(F.struct("query_id", "_item")).alias("_sought"))
    if rare.limit(SENT_ITEMS + 1).count() <= SENT_ITEMS:
        return _by_own_tokens(documents, written(sought, "sought"))
    pairs = rare.join(posted, "term").select("query_id", "doc_id")
    found = pairs.join(items.select("query_id", F.col("text").alias("_item")), "query_id").join(documents.select("doc_id", "text"), "doc_id")
    return found.where(F.col("text").contains(F.col("_item"))).select("query_id", "doc_id")


#: Items that are sent to every task.
SENT_ITEMS = 4096


def _by_own_tokens(documents: DataFrame, sought: DataFrame) -> DataFrame:
    """Each text meets the items of its own tokens where it is read: no pair and no text is shuffled."""
    every = F.broadcast(sought.agg(F.collect_list("term").alias("_terms")))
    own = documents.select("doc_id", "text").join(every, F.lit(True)).select("doc_id", "text", F.explode(F.array_intersect(F.array_distinct(tokens("text")), "_terms")).alias("term"))
    hit = F.filter("_sought", lambda i: F.contains(F.col("text"), i["_item"]))
    found = own.join(F.broadcast(sought), "term").select("doc_id", F.explode(hit).alias("i"))
    return found.select("i.query_id", "doc_id")


def _inner(text: str) -> Column:
    t = tokens(text)
    return F.when(F.size(t) >= 3, F.slice(t, 2, F.size(t) - 2)).otherwise(F.array().cast("array<string>"))


def ranking(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Metrics of every query in ``ranked(query_id, doc_id, rank)`` against ``gold(query_id, doc_id)``.

    The ideal of nDCG counts the relevant documents of the ranked list; recall and
    average precision divide by all relevant ones.  Without any relevant they are 0."""
    total = gold.groupBy("query_id").agg(F.count("*").alias("relevant"))
    marked = ranked.join(gold.withColumn("_g", F.lit(True)), ["query_id", "doc_id"], "left").withColumn("hit", F.col("_g").isNotNull() & (F.col("rank") <= k))
    hits = F.sum(F.col("hit").cast("int")).over(W.partitionBy("query_id").orderBy("rank"))
    marked = marked.withColumn("_i", hits)
    gain = lambda r: F.lit(1.0) / F.log2(r + F.lit(1.0))
    rows = marked.groupBy("query_id").agg(
        F.count_if("hit").alias("hits"),
        F.count_if(F.col("_g").isNotNull()).alias("listed"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"),
        F.coalesce(F.sum(F.when(F.col("hit"), gain(F.col("rank")))), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("_i") / F.col("rank"))), F.lit(0.0)).alias("ap"),
    )
    ideal = F.aggregate(F.when(F.col("listed") > 0, F.sequence(F.lit(1), F.least(F.lit(k), F.col("listed").cast("int")))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + gain(i))
    rows = rows.join(total, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    over = lambda x: F.when(F.col("relevant") > 0, F.round(x / F.col("relevant"), 6)).otherwise(0.0)
    return rows.select(
        "query_id", "hits", "relevant", "first_hit",
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_at_k"),
        F.round(F.col("hits") / k, 6).alias("precision_at_k"),
        over(F.col("hits")).alias("recall_at_k"),
        F.coalesce(F.round(1.0 / F.col("first_hit"), 6), F.lit(0.0)).alias("mrr_at_k"),
        F.when(ideal > 0, F.round(F.col("dcg") / ideal, 6)).otherwise(0.0).alias("ndcg_at_k"),
        over(F.col("ap")).alias("average_precision"),
    )


def points_found(points: Column, context: Column) -> Column:
    """How many of the points stand in the context, both squashed; empty points don't count."""
    return F.size(F.filter(points, lambda p: (squash(p) != "") & F.contains(squash(context), squash(p))))


def groups_found(groups: Column, text: Column) -> Column:
    """How many groups have a variant in the text."""
    return F.size(F.filter(groups, lambda g: points_found(g, text) > 0))


def graded(answer: Column, groups: Column, points: Column, expected: Column, declines: Column) -> Column:
    """True if every required group, or else any acceptable point, stands in the answer; ``declines`` accepts a refusal."""
    grouped = F.size(F.coalesce(groups, F.array())) > 0
    every = F.filter(F.concat(F.coalesce(points, F.array().cast("array<string>")), F.array(expected)), lambda p: p.isNotNull())
    flat = (points_found(every, answer) > 0) | F.coalesce(declines, F.lit(False))
    return (squash(answer) != "") & F.when(grouped, groups_found(groups, answer) == F.size(groups)).otherwise(flat)


def supports(answer: Column, context: Column) -> Column:
    """Best token F1 of each claim of the answer with any one sentence of the context: array<double>."""
    split = lambda text: F.transform(claims(text), lambda s: metric_tokens(s))
    return _best(split(answer), split(context))


@F.pandas_udf(ArrayType(DoubleType()))
def _best(said: pd.Series, known: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(said, known, strict=True):
        sentences = [Counter(s) for s in b]
        out.append([max((f1(Counter(c), s) for s in sentences), default=0.0) for c in a])
    return pd.Series(out)


def groundedness(rows: DataFrame, answer: str, context: str, threshold: float = UNGROUNDED) -> DataFrame:
    """Adds claims, groundedness (mean support) and ungrounded_fraction; all 0 without claims."""
    s = F.col("_s")
    n = F.size(s)
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    low = F.size(F.filter(s, lambda x: x < threshold))
    mean = lambda x: F.when(n > 0, F.round(x / n, 6)).otherwise(0.0)
    return rows.withColumn("_s", supports(F.col(answer), F.col(context))).select(*rows.columns, n.alias("claims"), mean(total).alias("groundedness"), mean(low).alias("ungrounded_fraction"))


def relevance(rows: DataFrame, key: list[str], answer: str, expected: str, embed: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """``key`` and answer_relevance: cosine of the embedded answer and expected answer; 0 where one is empty.

    ``embed`` makes (id, vector) from (id, text): the engine's embedder or any model."""
    ids = rows.select(*key, F.xxhash64(*key).alias("_id"), answer, expected)
    one = lambda c, name: embed(ids.select("_id", F.col(c).alias("text")), "_id", "text").select("_id", F.col("vector").alias(name))
    both = ids.join(one(answer, "_a"), "_id", "left").join(one(expected, "_e"), "_id", "left")
    return both.select(*key, F.round(F.coalesce(cosine("_a", "_e"), F.lit(0.0)), 4).alias("answer_relevance"))


def cited(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """query_id, cited_count, cited_ok, citation_precision (null without citations) of ``answers(query_id, answer)``.

    ``allowed(query_id, document, page)`` are the chunks that the answer was given."""
    refs = answers.select("query_id", F.posexplode_outer(citations("answer")).alias("n", "c")).select("query_id", "n", "c.document", "c.page")
    ok = refs.join(allowed.distinct().withColumn("_ok", F.lit(1)), ["query_id", "document", "page"], "left")
    n, good = F.count("n"), F.count("_ok")
    return ok.groupBy("query_id").agg(n.alias("cited_count"), good.alias("cited_ok"), F.when(n > 0, F.bround(good / n, 4)).alias("citation_precision"))


#: Fixed value: how an answer without context begins.
NOT_AVAILABLE = "The answer is not available"


def summary(rows: DataFrame) -> DataFrame:
    """One row over a run's rows, each measure with its own denominator.

    Means of ranking measures count a missing one as 0; grounding is averaged over
    answers with claims, relevance over answers that have one, NLI shares over
    answers with NLI claims; citation support is over citations, coverage over
    what was answered, and the rest over all rows."""
    n = F.greatest(F.count("*"), F.lit(1))
    blank = (F.coalesce("answer_text", F.lit("")) == "") | F.startswith("answer_text", F.lit(NOT_AVAILABLE))
    none = F.count_if(blank)
    answered = F.count("*") - none
    share = lambda x: F.bround(x / n, 4)
    mean = lambda c: F.bround(F.sum(F.coalesce(c, F.lit(0.0))) / n, 4).alias(c)
    with_claims = lambda c: F.coalesce(F.bround(F.avg(F.when(F.col("answer_claims") > 0, F.col(c))), 4), F.lit(0.0)).alias(c)
    with_nli = lambda c: F.bround(F.avg(F.when(F.col("nli_claim_count") > 0, F.col(c))), 4).alias(c)
    cites = F.sum(F.coalesce("cited_count", F.lit(0)))
    return rows.agg(
        F.count("*").alias("items"),
        share(F.count_if("answer_correct")).alias("answer_accuracy"),
        share(answered).alias("answered_rate"),
        share(none).alias("no_context_rate"),
        *(mean(c) for c in ("hit_at_k", "recall_at_k", "precision_at_k", "ndcg_at_k", "mrr_at_k", "context_precision", "context_recall")),
        with_claims("groundedness"),
        with_claims("ungrounded_fraction"),
        F.bround(F.avg("answer_relevance"), 4).alias("answer_relevance"),
        with_nli("nli_entailed_fraction"),
        with_nli("nli_contradiction_fraction"),
        F.count_if(F.col("nli_claim_count") > 0).alias("nli_rows_scored"),
        share(F.count_if("pii_leaked")).alias("pii_leak_rate"),
        F.when(cites > 0, F.bround(F.sum(F.coalesce("cited_ok", F.lit(0))) / cites, 4)).otherwise(0.0).alias("citation_support_rate"),
        F.bround(F.count_if(F.col("cited_count") > 0) / F.greatest(answered, F.lit(1)), 4).alias("citation_coverage"),
        share(F.count_if(F.col("fallbacks_tried") > 0)).alias("fallback_rate"),
        F.coalesce(F.bround(F.median("latency_s"), 3), F.lit(0.0)).alias("median_e2e_s"),
    )


def nli(scored: DataFrame) -> DataFrame:
    """claim, entailed, contradicted over all contexts of ``scored(claim, logits)``, logits as contradiction, entailment, neutral."""
    p = scored.select("claim", softmax("logits").alias("p"))
    best = p.groupBy("claim").agg(F.max(F.get("p", F.lit(1))).alias("ent"), F.max(F.get("p", F.lit(0))).alias("con"))
    entailed = (F.col("ent") >= 0.5) & (F.col("ent") >= F.col("con"))
    return best.select("claim", F.round("ent", 6).alias("entailment"), F.round("con", 6).alias("contradiction"), entailed.alias("entailed"), (~entailed & (F.col("con") >= 0.5)).alias("contradicted"))


def accuracy(rows: DataFrame, key: str, correct: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(correct).alias("correct"), F.bround(F.avg(correct.cast("double")), 4).alias("accuracy"))


def cost(calls: DataFrame, prices: DataFrame, default: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Adds cost of each call (provider, prompt_tokens, completion_tokens) by prices per million tokens."""
    priced = calls.join(prices.select("provider", "p", "c"), "provider", "left")
    p, c = F.coalesce("p", F.lit(default[0])), F.coalesce("c", F.lit(default[1]))
    return priced.withColumn("cost", (F.col("prompt_tokens") * p + F.col("completion_tokens") * c) / 1e6).drop("p", "c")


def within_budget(calls: DataFrame, key: str, order: list[str], limit: float) -> DataFrame:
    """Calls made before the running cost of their key passes the limit."""
    upto = F.sum("cost").over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return calls.withColumn("spent", F.round(upto, 9)).where(F.col("spent") <= limit)


def merged(prior: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Both runs' rows, fresh values first."""
    a, b = prior.select(key, *(F.col(c).alias(f"_{c}") for c in columns)), fresh.select(key, *columns)
    return a.join(b, key, "full_outer").select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in columns))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


def usage(response: Column) -> Column:
    """Token usage of a provider's JSON reply in either of two shapes: prompt, completion, total."""
    r = F.from_json(response, "usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, usageMetadata struct<promptTokenCount:int,candidatesTokenCount:int,totalTokenCount:int>")
    p = F.coalesce(r["usage"]["prompt_tokens"], r["usageMetadata"]["promptTokenCount"], F.lit(0))
    c = F.coalesce(r["usage"]["completion_tokens"], r["usageMetadata"]["candidatesTokenCount"], F.lit(0))
    t = F.coalesce(r["usage"]["total_tokens"], r["usageMetadata"]["totalTokenCount"], p + c)
    return F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"), t.alias("total_tokens"))
