"""Queries of de-duplication, boilerplate, reports and registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import extract as X
from foliant.operators import quality as Q
from foliant.plans.text import strip, tidy
from foliant.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents")


def dedup_chunks(spark, d):
    return Q.first_of(docs(spark, d), T.chunk_key(T.normalize("text")), F.col("doc_id")).select("doc_id")


def _hashed(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("content_hash"))


def dedup_skip(spark, d):
    """Odd documents arrive at a store that holds the even ones."""
    h = _hashed(spark, d)
    return Q.unseen(h.where("doc_id % 2 = 1"), h.where("doc_id % 2 = 0"), "content_hash").select("doc_id")


def dedup_replace(spark, d):
    h = _hashed(spark, d)
    return Q.last_of(h, F.col("content_hash"), F.col("doc_id")).select("doc_id")


def _paged(spark, d):
    """Five documents as the pages of one: a running head on four of them, a protected line on all, a short line on all."""
    group = F.expr("doc_id div 5")
    head = F.when(F.col("doc_id") % 5 < 4, F.concat(F.lit("Running head of volume "), group.cast("string"), F.lit("\n"))).otherwise("")
    return docs(spark, d).select(group.alias("volume"), "doc_id", F.concat(head, F.lit("Total due: 5 items listed\nShort\n"), "text").alias("text"))


def boilerplate_lines(spark, d):
    return Q.boilerplate(_paged(spark, d), "volume", "doc_id", "text").select(F.col("group").alias("volume"), "line", "pages")


def boilerplate_clean(spark, d):
    out = Q.without_boilerplate(_paged(spark, d), "volume", "doc_id", "text")
    return out.select(F.col("page").alias("doc_id"), F.md5("text").alias("text_md5"), "removed")


def drop_noise_chunks(spark, d):
    return docs(spark, d).where(~Q.is_noise(T.normalize("text"), 40)).select("doc_id")


def overcleaned_pages(spark, d):
    clean = F.length(F.regexp_replace("text", r"[^\x00-\x7F]|[a-z]+", ""))
    return docs(spark, d).select("doc_id", Q.is_overcleaned(F.length("text"), clean).alias("overcleaned"))


def ingest_report(spark, d):
    rows = docs(spark, d).select("source", "doc_id", "text", T.normalize("text").alias("t"))
    first = Q.first_of(rows, F.struct("source", T.chunk_key("t")), F.col("doc_id")).select("doc_id", F.lit(1).alias("_first"))
    rows = rows.join(first, "doc_id", "left")
    raw, clean = F.length("text"), F.length("t")
    engine = X.cascade({"text": (F.col("t"), X.is_good(F.col("t"))), "ocr": (F.col("text"), F.lit(True))}, "ocr")
    return rows.groupBy("source").agg(
        F.count("*").alias("pages"),
        F.count_if(clean < 100).alias("short_pages"),
        F.count_if(Q.is_noise(F.col("t"))).alias("noise_pages"),
        F.count_if(engine["engine"] == "ocr").alias("ocr_pages"),
        F.count_if(F.col("_first").isNull()).alias("dropped_duplicates"),
        F.count_if(Q.is_overcleaned(raw, clean)).alias("overcleaned"),
        F.sum(raw).alias("raw_chars"),
        F.sum(clean).alias("clean_chars"),
        F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"),
    )


def chunk_char_stats(spark, d):
    n = F.length("text")
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("chunks"), F.round(F.avg(n), 6).alias("mean_chars"), F.median(n).alias("median_chars"), F.max(n).alias("max_chars"))


def batch_rollup(spark, d):
    """Report of reports: totals, and the mean weighted by chunks."""
    one = docs(spark, d).groupBy("source").agg(F.count("*").alias("chunks"), F.avg(F.length("text")).alias("mean"))
    return one.agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.round(F.sum(F.col("mean") * F.col("chunks")) / F.sum("chunks"), 6).alias("mean_chars"))


def distinct_documents(spark, d):
    return docs(spark, d).select("source").distinct()


def registry_restore(spark, d):
    return docs(spark, d).groupBy("source").agg(F.countDistinct("doc_id").alias("pages"), F.sum(F.size(F.split("text", "\n"))).alias("chunks"))


def registry_drift(spark, d):
    p = table(spark, d, "pages").select(F.expr("page_id % 400").alias("doc_id"))
    return Q.drift(docs(spark, d).select("doc_id").where("doc_id % 3 = 0"), p, "doc_id")


def registry_upsert(spark, d):
    log = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return Q.latest(log, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


QUERIES = {f.__name__: f for f in (
    dedup_chunks, dedup_skip, dedup_replace, boilerplate_lines, boilerplate_clean, drop_noise_chunks, overcleaned_pages, ingest_report, chunk_char_stats,
    batch_rollup, distinct_documents, registry_restore, registry_drift, registry_upsert,
)}

_PROTECTED = Q.PROTECTED.replace("'", "''")
_LINES = r"""
paged AS (SELECT doc_id // 5 AS volume, doc_id, CASE WHEN doc_id %% 5 < 4 THEN 'Running head of volume ' || doc_id // 5 || chr(10) ELSE '' END || 'Total due: 5 items listed' || chr(10) || 'Short' || chr(10) || text AS text FROM documents),
sizes AS (SELECT volume, count(DISTINCT doc_id) AS total FROM paged GROUP BY volume),
lines AS (SELECT volume, doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM
  (SELECT volume, doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s', '', 'g') <> '') AS l FROM paged)),
boiler AS (SELECT volume, lower(line) AS low, count(DISTINCT doc_id) AS pages, any_value(total) AS total FROM lines JOIN sizes USING (volume) GROUP BY volume, lower(line)
  HAVING any_value(total) >= 3 AND pages >= greatest(2, ceil(any_value(total) * 0.6::DOUBLE)) AND length(low) >= 12 AND NOT regexp_matches(low, '%s'))""" % _PROTECTED

SQL = {
    "dedup_chunks": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(lower({tidy('text')}))",
    "dedup_skip": "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)",
    "dedup_replace": "SELECT max(doc_id) AS doc_id FROM documents GROUP BY sha256(text)",
    "boilerplate_lines": f"WITH {_LINES} SELECT volume, low AS line, pages FROM boiler",
    "boilerplate_clean": f"""WITH {_LINES},
marked AS (SELECT l.volume, l.doc_id, l.n, l.line, b.low IS NOT NULL AS gone FROM lines l LEFT JOIN boiler b ON b.volume = l.volume AND b.low = lower(l.line)),
parts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS whole, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS kept, count(*) FILTER (gone) AS removed FROM marked GROUP BY doc_id),
used AS (SELECT *, removed > 0 AND length(kept) >= 0.15::DOUBLE * length(whole) AS ok FROM parts)
SELECT d.doc_id, md5(CASE WHEN u.ok THEN kept ELSE text END) AS text_md5, CASE WHEN u.ok THEN removed ELSE 0 END::INT AS removed FROM paged d LEFT JOIN used u USING (doc_id)""",
    "drop_noise_chunks": rf"SELECT doc_id FROM documents WHERE regexp_matches({tidy('text')}, '[\p{{L}}\p{{N}}]') AND length({tidy('text')}) >= 40",
    "overcleaned_pages": r"SELECT doc_id, length(text) >= 100 AND length(regexp_replace(text, '[^\x00-\x7F]|[a-z]+', '', 'g')) / length(text) < 0.15::DOUBLE AS overcleaned FROM documents",
    "ingest_report": rf"""
WITH c AS (SELECT source, text, length(text) AS raw, {tidy('text')} AS t, row_number() OVER (PARTITION BY source, sha256(lower({tidy('text')})) ORDER BY doc_id) AS nth FROM documents)
SELECT source, count(*) AS pages, count_if(length(t) < 100)::BIGINT AS short_pages, count_if(NOT regexp_matches(t, '[\p{{L}}\p{{N}}]'))::BIGINT AS noise_pages, count_if((length(t) < 100 OR coalesce(length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) / nullif(length(regexp_replace(t, '\s', '', 'g')), 0) < 0.5, TRUE)) AND {strip('text')} <> '')::BIGINT AS ocr_pages, count_if(nth > 1)::BIGINT AS dropped_duplicates,
  count_if(raw >= 100 AND length(t) / raw < 0.15::DOUBLE)::BIGINT AS overcleaned, sum(raw)::BIGINT AS raw_chars, sum(length(t))::BIGINT AS clean_chars, count(DISTINCT sha256(text)) AS distinct_texts
FROM c GROUP BY source""",
    "chunk_char_stats": "SELECT lang, count(*) AS chunks, round(avg(length(text)), 6) AS mean_chars, median(length(text))::DOUBLE AS median_chars, max(length(text))::INT AS max_chars FROM documents GROUP BY lang",
    "batch_rollup": "SELECT count(DISTINCT source) AS documents, count(*) AS chunks, round(avg(length(text)), 6) AS mean_chars FROM documents",
    "distinct_documents": "SELECT DISTINCT source FROM documents",
    "registry_restore": "SELECT source, count(DISTINCT doc_id) AS pages, sum(len(string_split(text, chr(10))))::BIGINT AS chunks FROM documents GROUP BY source",
    "registry_drift": """
WITH a AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 = 0), b AS (SELECT DISTINCT page_id % 400 AS doc_id FROM pages)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'store_only' WHEN b.doc_id IS NULL THEN 'registry_only' ELSE 'both' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    "registry_upsert": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
