"""Queries of personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import redact as R
from foliant.operators.recognizers import RECOGNIZERS
from foliant.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents")


def pii_detect(spark, d):
    s = docs(spark, d).select("doc_id", F.explode(R.detect("text")).alias("s"))
    return s.select("doc_id", "s.entity", "s.start", "s.end", F.round("s.score", 4).alias("score"))


#: A lead that puts a label before some of a document's words and numbers, so that every labelled pattern has something to find.
LEADS = (
    "A/c No. 30123456789", "loan account no: 12345678901 and loan # AB12CD34", "Mr. Ram Nath Sharma, s/o Gopal Das, H.No. 12-B, Rose Villa", "Gandhi Nagar, Delhi - 110001", "UPI id: ravi.k@okbank vpa: x.y1@upi pay to: shop.a@bank",
    "cheque no. 123456 dated 2024, Policy No: LIC-998877", "PAN ABCDE1234F GSTIN 22ABCDE1234F1Z5 IFSC SBIN0001234", "voter ABC1234567 tan ABCD12345E dl MH12 20200012345 passport K1234567", "application no. APP-2024-77 customer number: CUST-0042",
    "card 4111 1111 1111 1111 ssn 123-45-6789 iban GB82 WEST 1234 5698 7654 32", "call +91 98765 43210 or (022) 2345 6789", "savings account number is 9876-5432-1098, emi a/c 11112222333",
)


def pii_candidates(spark, d):
    """Matches of every pattern in documents that begin with labelled values, by entity."""
    lead = F.get(F.array(*map(F.lit, LEADS)), (F.col("doc_id") % len(LEADS)).cast("int"))
    one = docs(spark, d).select("doc_id", F.concat(lead, F.lit(" ; "), F.col("doc_id").cast("string"), F.lit(" .\n"), "text").alias("t"))
    found = one.select("doc_id", F.explode(R.candidates("t")).alias("x"))
    return found.groupBy("doc_id", "x.entity").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("x.part")), "|")).alias("parts_md5"))


def pii_scrub(spark, d):
    return docs(spark, d).select("doc_id", F.md5(R.redact("text")).alias("text_md5"))


def pii_redact_regex(spark, d):
    return docs(spark, d).select("doc_id", F.md5(R.redact_fixed(F.col("text"))).alias("text_md5"))


EMAIL, CARD, IP = (p for _, p in R.FIXED[:3])


def pii_counts(spark, d):
    found = [F.struct(F.lit(e).alias("entity"), F.regexp_count("text", F.lit(p)).alias("n")) for e, p in R.FIXED]
    return docs(spark, d).select("doc_id", F.explode(F.array(*found)).alias("x")).groupBy("x.entity").agg(F.sum("x.n").alias("spans"), F.count_if(F.col("x.n") > 0).alias("documents"))


def pii_leak_rate(spark, d):
    s = R.leak_score(F.col("text"))
    return docs(spark, d).groupBy("source").agg(F.round(F.avg(s), 6).alias("leak_rate"), F.count_if(s > 0).alias("leaking"))


GENERIC = ("PHONE_NUMBER", "CREDIT_CARD")


def _spans(text):
    """Runs of digits as generic spans, and the ends of long ones as specific spans, by rule."""
    at = F.col("doc_id") % 7
    mk = lambda e, s, t, p: F.struct(F.lit(e).alias("entity"), s.cast("int").alias("start"), t.cast("int").alias("end"), F.lit(p).alias("score"))
    return F.array(mk("PHONE_NUMBER", at, at + 12, 0.5), mk("PAN_NUMBER", at + 2, at + 12, 0.6), mk("CREDIT_CARD", at + 20, at + 30, 0.9), mk("IFSC_CODE", at + 25, at + 36, 0.6))


def span_shadowing(spark, d):
    s = docs(spark, d).select("doc_id", F.explode(R.unshadowed(_spans("text"), GENERIC)).alias("s"))
    return s.select("doc_id", "s.entity", "s.start", "s.end")


def span_rebase(spark, d):
    s = docs(spark, d).select("doc_id", F.explode(R.rebased(_spans("text"), F.lit(15))).alias("s"))
    return s.select("doc_id", "s.entity", "s.start", "s.end")


def context_carry(spark, d):
    c = R.with_carry(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return c.select("conv_id", "turn", "carry")


QUERIES = {f.__name__: f for f in (pii_detect, pii_candidates, pii_scrub, pii_redact_regex, pii_counts, pii_leak_rate, span_shadowing, span_rebase, context_carry)}


def fixed_sql(t: str) -> str:
    """``redact.redact_fixed`` of an SQL expression."""
    for entity, pattern in R.FIXED:
        two = "\\2" if pattern.count("(") > 1 else ""
        t = f"regexp_replace({t}, '{pattern}', '\\1<{entity}>{two}', 'g')"
    return t


_LEAK = " + ".join(f"regexp_matches(text, '(?i){p}')::INT" for p in R.LEAKS)
_RULE = """s AS (SELECT doc_id, unnest([{'entity': 'PHONE_NUMBER', 'start': doc_id % 7, 'end': doc_id % 7 + 12}, {'entity': 'PAN_NUMBER', 'start': doc_id % 7 + 2, 'end': doc_id % 7 + 12},
  {'entity': 'CREDIT_CARD', 'start': doc_id % 7 + 20, 'end': doc_id % 7 + 30}, {'entity': 'IFSC_CODE', 'start': doc_id % 7 + 25, 'end': doc_id % 7 + 36}]) AS x FROM documents)"""

def _candidates() -> str:
    """Every pattern over the same texts; a look-behind becomes a character that is matched and left out."""
    parts = []
    for entity, pattern, _, _, group, _, _ in RECOGNIZERS:
        if pattern.startswith("(?<![\\w.])"):
            pattern, group = "(?:^|[^\\w.])(" + pattern.removeprefix("(?<![\\w.])") + ")", 1
        parts.append(f"SELECT doc_id, '{entity}' AS entity, unnest(regexp_extract_all(t, '(?ism){pattern}', {group})) AS part FROM leads")
    return " UNION ALL ".join(parts)


_LEADS = f"leads AS (SELECT doc_id, ({list(LEADS)})[doc_id % {len(LEADS)} + 1] || ' ; ' || doc_id || ' .' || chr(10) || text AS t FROM documents)"

SQL = {
    "pii_candidates": f"WITH {_LEADS}, m AS ({_candidates()}) SELECT doc_id, entity, count(*) AS n, md5(string_agg(part, '|' ORDER BY part)) AS parts_md5 FROM m WHERE part <> '' GROUP BY doc_id, entity",
    "pii_redact_regex": f"SELECT doc_id, md5({fixed_sql('text')}) AS text_md5 FROM documents",
    "pii_counts": " UNION ALL ".join(
        f"SELECT '{e}' AS entity, sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS spans, count_if(regexp_matches(text, '{p}'))::BIGINT AS documents FROM documents" for e, p in R.FIXED
    ),
    "pii_leak_rate": f"SELECT source, round(avg(({_LEAK}) / 11), 6) AS leak_rate, count_if(({_LEAK}) > 0)::BIGINT AS leaking FROM documents GROUP BY source",
    "span_shadowing": f"""WITH {_RULE}
SELECT doc_id, x.entity AS entity, x.start::INT AS start, x."end"::INT AS "end" FROM s WHERE x.entity NOT IN ('PHONE_NUMBER', 'CREDIT_CARD')
  OR NOT EXISTS (SELECT 1 FROM s AS o WHERE o.doc_id = s.doc_id AND o.x.entity NOT IN ('PHONE_NUMBER', 'CREDIT_CARD') AND s.x.start <= o.x.start AND o.x."end" <= s.x."end")""",
    "span_rebase": f"""WITH {_RULE} SELECT doc_id, x.entity AS entity, greatest(x.start - 15, 0)::INT AS start, (x."end" - 15)::INT AS "end" FROM s WHERE x."end" > 15""",
    "context_carry": "SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 80), '') AS carry FROM conversations",
}
