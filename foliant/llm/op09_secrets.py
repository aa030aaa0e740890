"""Secret scans with corpus-wide ownership frequency.

Base spans come from three patterns (assignments, access keys, long hex runs)
and always stay.  Wider candidates are long tokens that mix letters and digits.
The values of all spans are hashed, and each hash is counted over distinct
repositories (documents) and distinct owners (sources) of the whole corpus.  A
value of many owners, or of many repositories for each of its owners, is a
copied example; a value of few of both is owner-specific and looks live.  Live
wide spans are added where they overlap no base span.  Every span carries its
counts and its class.

Only DataFrame expressions are used.  Offsets come from the matches and the
gaps between them (extract-all beside split by the same pattern), in code
points, end exclusive, summed in runs of ``RUN`` matches so that a text of many
matches costs little more than as many steps.  The scan is written once without
texts; counts are aggregated in steps (hash, owner and repository, then hash).

Edge cases: a null or empty text has no spans (counts 0, ``spans`` empty);
repeated rows each get their own result and count as one repository per id and
owner, and so do null ids; a null source is an owner of its own; empty tables
give no rows; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import RID, numbered, settled, table, written

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # runs of AKIA[A-Z0-9]+ with 16 or more characters
HEX = r"[0-9a-f]{32,}"  # runs of [0-9a-f]+ with 32 or more characters
KINDS = ("assign", "access", "hex", "value")


@dataclass(frozen=True)
class Ownership:
    """Parameters of the method."""

    candidate: str = r"[A-Za-z0-9_+/-]{20,}"  # wider candidates; they must mix letters and digits
    least_digits: int = 3
    least_distinct: int = 10  # distinct characters
    most_owners: int = 2  # a value of more owners is a copied example
    most_repositories: int = 8  # for each owner; a value of more is a copied example


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


#: Matches whose offsets are summed in one inner step.
RUN = 256


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, end, value>>.

    The k-th match starts after k+1 gaps and k matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast(SPANS)

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gaps"])
        end = begin + F.length(pair["found"])
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), pair["found"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def run(acc: Column, pairs: Column) -> Column:
        inner = F.aggregate(pairs, F.struct(acc["at"].alias("at"), none.alias("spans")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["runs"], F.array(inner["spans"])).alias("runs"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gaps"), found.alias("found"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda i: F.slice(pairs, i * RUN + 1, F.lit(RUN)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("runs"))
    return F.when(text.rlike(pattern), F.aggregate(runs, start, run, lambda acc: F.flatten(acc["runs"]))).otherwise(none)


def _value(span: Column) -> Column:
    """The secret itself: of an assignment, what is assigned."""
    return F.when(span["kind"] == KINDS.index("assign"), F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def _live_looking(spans: Column, o: Ownership) -> Column:
    def mixed(s: Column) -> Column:
        v = s["value"]
        digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
        distinct = F.size(F.array_distinct(F.split(v, "")))
        return (digits >= o.least_digits) & v.rlike("[A-Za-z]") & (distinct >= o.least_distinct)

    return F.filter(spans, mixed)


def spans_of(text: Column, o: Ownership) -> Column:
    """All spans of a text in order, with the hash of the value."""
    text = F.coalesce(text, F.lit(""))
    assigned = F.filter(matches(text, ASSIGN, "assign"), lambda s: F.length(_value(s)) >= 8)
    spans = F.concat(assigned, matches(text, ACCESS, "access"), matches(text, HEX, "hex"), _live_looking(matches(text, o.candidate, "value"), o))
    return F.transform(F.array_sort(spans), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(_value(s), 256).alias("hash")))


def ownership(scanned: DataFrame) -> DataFrame:
    """Distinct repositories (documents of an owner) and owners (sources) of every hash of ``scanned(doc_id, source, spans)``."""
    each = scanned.select("doc_id", "source", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    by_owner = each.groupBy("hash", "source", "doc_id").agg(F.lit(1).alias("_one")).groupBy("hash", "source").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def classed(scanned: DataFrame, o: Ownership) -> DataFrame:
    """rid and spans(start, kind, end, hash, repositories, owners, live) of the rows of ``scanned(rid, doc_id, source, spans)`` that have any."""
    spans = scanned.select("rid", F.explode("spans").alias("span")).select("rid", "span.*").join(ownership(scanned), "hash")
    live = (F.col("owners") <= o.most_owners) & (F.col("repositories") <= o.most_repositories * F.col("owners"))
    return spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "repositories", "owners", live.alias("live")))).alias("spans"))


def find_secrets(documents: DataFrame, o: Ownership = Ownership()) -> DataFrame:
    """One row per document: doc_id, and spans(start, kind, end, hash, repositories, owners, live); null if there are none."""
    rid = F.monotonically_increasing_id().alias("rid")
    scanned = written(documents.select(rid, "doc_id", "source", spans_of(F.col("text"), o).alias("spans")), "secret-scan")
    return scanned.select("rid", "doc_id").join(classed(scanned, o), "rid", "left").drop("rid")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < KINDS.index("value"))


def final_spans(spans: Column) -> Column:
    """Base spans, and live wide spans that overlap none of them."""
    clear = lambda s: ~F.exists(base_spans(spans), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.filter(spans, lambda s: (s["kind"] < KINDS.index("value")) | (s["live"] & clear(s)))


def _listing(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    line = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.coalesce(F.array_join(line, ","), F.lit(""))


def _classes(spans: Column) -> Column:
    """class:repositories:owners of each span."""
    line = F.transform(spans, lambda s: F.concat_ws(":", F.when(s["live"], "live").otherwise("copied"), s["repositories"], s["owners"]))
    return F.coalesce(F.array_join(line, ","), F.lit(""))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))), F.lit(0)).cast("long")
    none = F.when(F.col("spans").isNull(), F.lit(0))
    return found.withColumn("final", final_spans(F.col("spans"))).select(
        "doc_id",
        F.coalesce(none, count("assign")).cast("long").alias("n_assign"),
        F.coalesce(none, count("access")).cast("long").alias("n_access"),
        F.coalesce(none, count("hex")).cast("long").alias("n_hex"),
        F.sha2(_listing(base_spans(F.col("spans"))), 256).alias("base_sha256"),
        _listing(F.col("final")).alias("spans"),
        _classes(F.col("final")).alias("span_classes"),
    )


def mask_secrets(documents: DataFrame, o: Ownership = Ownership(), mark: str = "<SECRET>", copied_mark: str = "<EXAMPLE_SECRET>") -> DataFrame:
    """``documents`` with live spans replaced by ``mark`` and copied base spans by ``copied_mark``; n_chars follows, other columns stay.

    Overlapping spans are merged first, and are live if one of them is.  Rows are
    numbered; those without spans pass by, the others meet theirs by number."""
    rows = numbered(documents, "secret-rows", __foliant_spans=spans_of(F.col("text"), o))
    scanned = rows.select(F.col(RID).alias("rid"), "doc_id", "source", F.col("__foliant_spans").alias("spans")).where(F.size("spans") > 0)
    spans = classed(scanned, o).select(F.col("rid").alias(RID), final_spans(F.col("spans")).alias("__foliant_final"))

    def merge(acc: Column, s: Column) -> Column:
        """Spans as disjoint ones: a span that begins inside the last one moves its end."""
        last = F.element_at(acc, -1)
        inside = (F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), (last["live"] | s["live"]).alias("live"))
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["live"].alias("live"))
        return F.when(inside, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(one)))

    def step(acc: Column, s: Column) -> Column:
        text = F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.when(s["live"], mark).otherwise(copied_mark))
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(text)).alias("out"))

    clear = rows.where(F.size("__foliant_spans") == 0).select(*documents.columns)
    merged = F.aggregate("__foliant_final", F.array().cast("array<struct<start:int,end:int,live:boolean>>"), merge)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    found = rows.where(F.size("__foliant_spans") > 0).join(spans, RID)
    some = F.size("__foliant_final") > 0
    found = found.withColumn("text", F.when(some, F.aggregate(merged, start, step, rest)).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        found = found.withColumn("n_chars", F.when(some, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clear.unionByName(found.select(*documents.columns))


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return settled(lambda: digest(find_secrets(documents)), "secrets")


def _sql_matches(pattern: str, kind: int, more: str = "TRUE", where: str = "TRUE") -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT rid, {kind} AS kind, s AS start, s + length(v) AS end_, v FROM (
    SELECT rid, unnest(f) AS v, unnest(list_transform(range(1, len(f) + 1), lambda i: list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[:i - 1], lambda x: length(x))), 0)))::BIGINT AS s
    FROM (SELECT rid, regexp_extract_all(t, '{quoted}') AS f, regexp_split_to_array(t, '{quoted}') AS g FROM docs WHERE regexp_matches(t, '{quoted}')))
  WHERE {more}"""


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
base AS (
{_sql_matches(ASSIGN, 0, f"length(regexp_extract(v, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 8")}
UNION ALL
{_sql_matches(ACCESS, 1)}
UNION ALL
{_sql_matches(HEX, 2)}),
wide AS (
{_sql_matches(Ownership.candidate, 3, "length(regexp_replace(v, '[^0-9]', '', 'g')) >= 3 AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 10")}),
valued AS (
  SELECT rid, kind, start, end_, CASE WHEN kind = 0 THEN regexp_extract(v, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2) ELSE v END AS v FROM base
  UNION ALL SELECT rid, kind, start, end_, v FROM wide),
owned AS (
  SELECT v, count(DISTINCT coalesce(source, '<null>') || ' ' || coalesce(doc_id::VARCHAR, '<null>')) AS repositories, count(DISTINCT coalesce(source, '<null>')) AS owners
  FROM valued JOIN docs USING (rid) GROUP BY v),
every AS (
  SELECT rid, kind, start, end_, kind < 3 AS is_base, CASE WHEN owners <= 2 AND repositories <= 8 * owners THEN 'live' ELSE 'copied' END AS class, repositories, owners
  FROM valued w JOIN owned USING (v)
  WHERE kind < 3 OR (owners <= 2 AND repositories <= 8 * owners AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.start < w.end_ AND w.start < b.end_))),
listed AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex', 'value'][kind + 1] || ':' || start || ':' || end_, ',' ORDER BY start, kind, end_) FILTER (is_base) AS b,
    string_agg(['assign', 'access', 'hex', 'value'][kind + 1] || ':' || start || ':' || end_, ',' ORDER BY start, kind, end_) AS spans,
    string_agg(class || ':' || repositories || ':' || owners, ',' ORDER BY start, kind, end_) AS classes
  FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(classes, '') AS span_classes
FROM docs LEFT JOIN listed USING (rid)
"""
