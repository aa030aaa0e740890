"""Conversations, question gates, routing and answers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import ellipsis, strip, word_count

#: Beginnings of questions that refer back.
FOLLOWUP = (
    "what about", "how about", "and the", "and its", "and their", "is it", "is that", "is there", "are they", "are there", "are these", "are those", "does it", "do they",
    "did it", "can it", "can they", "tell me more", "what else", "why is", "why does", "why did", "same ", "again", "the second", "the first", "the third", "that one",
    "this one", "those", "them",
)

#: Patterns of each intent.  Edges are spelled out, so that every regex engine agrees.
_L, _R = r"(?:^|[^a-z0-9_])", r"(?:$|[^a-z0-9_])"
INTENTS = {
    "analysis": tuple(_L + p for p in (
        "compar", "discrepanc", "inconsisten", "mismatch", "risk", "complian", "verify" + _R, "validate" + _R, "why" + _R, "calculat", "does .* (?:match|meet|satisfy)" + _R,
        "eligib", "default", "flag", "assess", "impact" + _R,
    )),
    "summary": tuple(_L + p for p in (
        "summar", "overview" + _R, "explain" + _R, "describe" + _R, "in brief" + _R, "key (?:points|terms)" + _R, "what is this (?:document|file)" + _R, "tl;?dr" + _R, "highlights?" + _R,
    )),
    "lookup": tuple(_L + p + _R for p in (
        "what is the", "how much", "when", "who", "which", "amount", "date", "rate", "name", "number", "term", "tenure", "emi", "page", "where",
    )),
}
PREFERRED = {"analysis": "nvidia", "summary": "groq", "lookup": "groq", "general": "groq"}
CHAIN = ("groq", "nvidia", "gemini")

#: Phrases that decline to answer, and that tell of a spent quota.
REFUSALS = (
    "not provided", "not stated", "not specified", "does not provide", "does not state", "does not say", "does not mention", "not mentioned", "not available",
    "not in the document", "no information", "cannot be determined", "cannot be inferred", "not include", "not contain", "does not contain", "is not available",
    "no bank account number",
)


def turns(messages: DataFrame) -> DataFrame:
    """User and assistant turns that say something."""
    return messages.where(F.col("role").isin("user", "assistant") & (strip("text") != ""))


def history(messages: DataFrame, most: int = 6, chars: int = 1000) -> DataFrame:
    """The last ``most`` turns of each conversation (0: none, below 0: all), each shortened to ``chars``."""
    kept = turns(messages).withColumn("text", ellipsis(strip("text"), chars))
    if most < 0:
        return kept
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return kept.withColumn("_back", back).where(F.col("_back") <= most).drop("_back")


def overflow(messages: DataFrame, trigger: int = 12, keep: int = 6) -> DataFrame:
    """Turns to fold into a summary: all but the last ``keep`` of conversations with more than ``trigger``."""
    kept = turns(messages)
    n = F.count("*").over(W.partitionBy("conv_id"))
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return kept.withColumn("_n", n).withColumn("_back", back).where((F.col("_n") > trigger) & (F.col("_back") > keep)).drop("_n", "_back")


def transcript(messages: DataFrame) -> DataFrame:
    """conv_id, transcript: "User: ..." lines in order."""
    line = F.concat(F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise(F.col("role")), F.lit(": "), F.col("text"))
    held = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("x"))
    return held.select("conv_id", F.array_join(F.transform("x", lambda v: v["l"]), "\n").alias("transcript"))


def is_followup(text: Column, most_words: int = 6) -> Column:
    """Short, or beginning like a reference to what was said."""
    t = F.lower(strip(text))
    begins = reduce(lambda a, b: a | b, (t.startswith(m) for m in FOLLOWUP))
    return (t != "") & ((word_count(t) <= most_words) | begins)


def should_expand(text: Column, least_words: int = 7, enabled: bool = True) -> Column:
    return F.lit(enabled) & (word_count(text) >= least_words)


def validation(text: Column, most: int = 5000) -> Column:
    """empty, too_long or ok."""
    return F.when(F.coalesce(strip(text), F.lit("")) == "", "empty").when(F.length(strip(text)) > most, "too_long").otherwise("ok")


def _shows(text: Column, pattern: str) -> Column:
    """The pattern, looked for only where the letters that it begins with stand: a plain search costs a fraction of a pattern's."""
    stem = re.match(r"[a-z ]+(?![?*{])", pattern.removeprefix(_L))[0]
    return text.contains(stem) & text.rlike(pattern)


def intent(text: Column) -> Column:
    """The class with most of its patterns in the question; analysis, summary, lookup on ties; general without any."""
    low = F.lower(text)
    score = {k: sum((_shows(low, p).cast("int") for p in patterns), F.lit(0)) for k, patterns in INTENTS.items()}
    # The greatest of (score, precedence, name) names each pattern once; a comparison of scores would look for all of them again.
    named = lambda s, at, k: F.struct(s.alias("n"), F.lit(at).alias("at"), k.alias("name"))
    none = named(F.lit(0), len(score), F.when(low.isNotNull(), "general"))
    return F.greatest(none, *(named(s, -i, F.lit(k)) for i, (k, s) in enumerate(score.items())))["name"]


def provider_order(intent_name: Column, available: Column, cooling: Column) -> Column:
    """The intent's provider, then the chain, then whatever is available; cooling ones at the back."""
    first = F.create_map(*[F.lit(x) for pair in PREFERRED.items() for x in pair])
    wanted = F.array_distinct(F.concat(F.array(F.element_at(first, intent_name)), F.array(*map(F.lit, CHAIN)), available))
    # Functions of whole arrays: a lambda over ``wanted`` would evaluate the intent again for each use.
    usable = F.array_intersect(wanted, F.array_compact(available))
    resting = F.coalesce(cooling, F.array().cast("array<string>"))
    return F.concat(F.array_except(usable, resting), F.array_intersect(usable, resting))


def refuses(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(text).contains(m) for m in REFUSALS))


def context_blocks(ranked: DataFrame) -> DataFrame:
    """query_id, context: "[Doc: name | Page n]" blocks in rank order."""
    block = F.concat(F.lit("[Doc: "), "filename", F.lit(" | Page "), F.col("page_number").cast("string"), F.lit("]\n"), "content")
    held = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return held.select("query_id", F.array_join(F.transform("x", lambda v: v["b"]), "\n\n").alias("context"))


def citations(ranked: DataFrame, snippet: int = 220) -> DataFrame:
    """The best chunk of each document and page as a citation, by falling score; pages that are no numbers are left out.

    On equal scores the earlier rank stands for the page."""
    page = F.col("page_number").cast("string").try_cast("int")
    rows = ranked.withColumn("page_number", page).where("page_number is not null")
    best = rows.groupBy("query_id", "document_id", "page_number").agg(F.max_by(F.struct("score", "rank", "filename", "content"), F.struct("score", -F.col("rank"))).alias("b"))
    order = W.partitionBy("query_id").orderBy(F.col("b.score").desc(), "b.rank")
    return best.select(
        "query_id", F.row_number().over(order).alias("n"), "document_id", "page_number", "b.score", "b.filename", F.substring("b.content", 1, snippet).alias("snippet")
    )


#: Fixed value: the stand-in's sentence, in three parts.
SIMULATED = ("[SIMULATED] Answer to '", "' based on ", " chars of context.")


def simulated_answer(question: Column, context: Column) -> Column:
    """A deterministic stand-in for a generator."""
    return F.concat(F.lit(SIMULATED[0]), F.substring(question, 1, 80), F.lit(SIMULATED[1]), F.length(strip(context)).cast("string"), F.lit(SIMULATED[2]))


def listed(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Conversations with their number of messages, also those without any."""
    n = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    return conversations.join(n, "conv_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def login(accounts: DataFrame, claims: DataFrame) -> DataFrame:
    """The account of each claim: by subject, else by address; none if disabled or bound to another subject."""
    by_sub = accounts.select(F.col("sub").alias("claim_sub"), F.struct("user_id", "sub", "status").alias("_a"))
    by_mail = accounts.select(F.lower(F.trim("email")).alias("claim_email"), F.struct("user_id", "sub", "status").alias("_b"))
    found = claims.withColumn("claim_email", F.lower(F.trim("claim_email"))).join(by_sub, "claim_sub", "left").join(by_mail, "claim_email", "left")
    who = F.coalesce("_a", "_b")
    ok = (who["status"] == "active") & (who["sub"].isNull() | (who["sub"] == F.col("claim_sub")))
    return found.select("claim_id", F.when(ok, who["user_id"]).alias("user_id"))
