"""Queries of the scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.sources.tables import table


#: Letters whose upper case every engine agrees on.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _documents(spark, d, *columns):
    return table(spark, d, "documents").select(*columns)


def tokenize(spark, d):
    t = T.tokens("text")
    return _documents(spark, d, "doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("token_md5"))


def normalize_text(spark, d):
    return _documents(spark, d, "doc_id", F.md5(T.normalize("text")).alias("clean_md5"))


def normalize_ws(spark, d):
    c = T.tidy("text")
    return _documents(spark, d, "doc_id", F.md5(c).alias("clean_md5"), F.length(c).alias("clean_chars"))


def cleaning_stats(spark, d):
    """An empty text has no ratio (NaN); a missing one has no figures."""
    sizes = _documents(spark, d, "doc_id", F.length("text").alias("raw_chars"), F.length(T.normalize("text")).alias("_clean"))  # cleaned once, whatever uses it
    raw, clean = F.col("raw_chars"), F.when(F.col("raw_chars").isNotNull(), F.col("_clean"))
    ratio = F.when(raw == 0, F.lit(float("nan"))).otherwise(F.round(clean / raw, 6))
    return sizes.select("doc_id", "raw_chars", clean.alias("clean_chars"), ratio.alias("ratio"))


def _marked_up():
    """Texts with markup of every kind added: a header, a list, emphasis, code, links, rules and a table."""
    w = F.split("text", " ")
    at = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit("x"))
    return F.concat(
        F.lit("## "), at(0), F.lit("\n- "), at(1), F.lit(" *"), at(2), F.lit("* *"), at(3), F.lit("* **"), at(4), F.lit("** a*b\n- 5 `"), at(5), F.lit("` [l](u) ![i](v)\n---\n```py\n| a | b |\n|---|:--|\n"), F.col("text")
    )


def strip_markdown(spark, d):
    return _documents(spark, d, "doc_id", F.md5(T.strip_markdown(_marked_up())).alias("plain_md5"))


def gibberish_flag(spark, d):
    c = T.normalize("text")
    return _documents(spark, d, "doc_id", F.round(T.alnum_ratio(c), 6).alias("alnum_ratio"), T.is_gibberish(c).alias("gibberish"), (F.length(c) >= 100).alias("sufficient"))


def split_claims(spark, d):
    c = T.claims("text")
    return _documents(spark, d, "doc_id", F.size(c).alias("n_claims"), F.md5(F.array_join(c, "|")).alias("claims_md5"))


def nli_claims(spark, d):
    c = T.nli_claims("text")
    return _documents(spark, d, "doc_id", F.size(c).alias("n_claims"), F.md5(F.array_join(c, "|")).alias("claims_md5"))


def metadata_coerce(spark, d):
    """Columns of orders, a flag and a list as metadata."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", (F.col("o_orderkey") % 2 == 0).alias("flag"), F.array("o_custkey", "o_orderkey").alias("ids"))
    return o.select(*(T.coerced(F.col(c), kind).alias(c) for c, kind in o.dtypes)).withColumn("ids", F.array_join("ids", "|"))


def mc_prompt(spark, d):
    choices = F.array("lang", "source", F.substring("text", 1, 20))
    return _documents(spark, d, "doc_id", F.md5(T.choice_prompt(F.concat(F.lit("Which of document "), F.col("doc_id").cast("string"), F.lit("?")), choices)).alias("prompt_md5"))


def metric_tokens(spark, d):
    t = T.metric_tokens("text")
    return _documents(spark, d, "doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("token_md5"))


def content_hash(spark, d):
    return _documents(spark, d, "doc_id", F.sha2("text", 256).alias("content_hash"), T.chunk_key(T.normalize("text")).alias("chunk_key"))


def page_set_digest(spark, d):
    """Digest of the normalised pages of each document: turns as the pages of their conversation."""
    pages = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", T.normalize("text").alias("t")))).alias("pages"))
    return pages.select("conv_id", F.sha2(F.array_join(F.transform("pages", lambda p: p["t"]), "\n\n"), 256).alias("digest"))


def source_digest(spark, d):
    """Digest of a whole source, however large: of its pages' digests by bucket, and of the buckets'."""
    page = table(spark, d, "documents").select("source", "doc_id", F.expr("doc_id div 512").alias("b"), F.sha2(T.normalize("text"), 256).alias("h"))
    digest = lambda order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), "\n"), 256)
    return page.groupBy("source", "b").agg(digest("doc_id").alias("h")).groupBy("source").agg(digest("b").alias("digest"))


def context_header(spark, d):
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Title "), F.col("lang")))
    return _documents(spark, d, "doc_id", T.context_header(title, F.concat(F.lit("docs/"), "source", F.lit(".v1.txt")), "doc_id").alias("header"))


def truncate_ellipsis(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.ellipsis("text", 60).alias("short"))


def parse_citations(spark, d):
    """Texts that cite: a path, a page spelled out, two side by side, and one that isn't closed."""
    page = lambda k: (F.col("doc_id") % k).cast("string")
    first = F.concat(F.lit(" (Files\\sub/"), F.upper("source"), F.lit(".PDF, p."), page(17), F.lit(") (x, "), "lang", F.lit(", Page "), page(90), F.lit(")(b.txt,p "), page(5), F.lit(") (open, p.7 "))
    answer = F.when(F.col("doc_id") % 4 == 3, F.col("text")).otherwise(F.concat("text", first))
    return _documents(spark, d, "doc_id", F.posexplode(T.citations(answer)).alias("n", "c")).select("doc_id", "n", "c.document", "c.page")


def expansion_parse(spark, d):
    """Turns as questions, and a reply made of their words as a list: bullets, numbers, quotes, repeats in other case and spacing, blanks."""
    w = lambda a, n: F.array_join(F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), a, n), " ")
    reply = F.concat(F.lit("1. "), w(1, 4), F.lit("\n- '"), F.translate(w(1, 4), LETTERS, LETTERS.upper()), F.lit("'\n\n* \""), w(2, 3), F.lit("\"\n  \n12. "), F.regexp_replace(w(2, 3), " ", "   "), F.lit("\n\u2022 "), w(3, 5), F.lit("\n"), "text", F.lit("\nlast one"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.list_lines(reply, "text", 3)).alias("n", "variant"))


def softmax_rows(spark, d):
    s = T.softmax(F.slice("embedding", 1, 3))
    return table(spark, d, "embeddings").select("vec_id", *(F.round(F.get(s, F.lit(i)), 6).alias(f"p{i}") for i in range(3)))


def verhoeff(spark, d):
    """Numbers of twelve digits from ids, and a few that are no numbers."""
    digits = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("12x"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 13 == 0, "").otherwise((F.col("doc_id") * 7919 + 234567890124).cast("string"))
    return _documents(spark, d, "doc_id", T.verhoeff(digits).alias("valid"))


def choice_parse(spark, d):
    """Turns answered by a letter in a sentence, by a choice's whole text in other case, by a letter beyond the choices, or not at all."""
    letter = F.char((F.lit(65) + F.col("turn") % 5).cast("int"))
    choices = F.array("role", F.substring("text", 1, 12), F.lit("None of These"))
    reply = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("The answer is "), letter, F.lit("."))).when(F.col("conv_id") % 4 == 1, F.translate(F.substring("text", 1, 12), LETTERS, LETTERS.upper()))
    reply = reply.when(F.col("conv_id") % 4 == 2, F.concat(F.lit("("), letter, F.lit(")"))).otherwise(F.lit("none  of these"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.choice(reply, choices).alias("choice"))


def cosine_pairs(spark, d):
    """Every vector against the first of its label."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("first_id"))
    first = first.join(e.select(F.col("vec_id").alias("first_id"), F.col("embedding").alias("first")), "first_id")
    return e.join(first, "label").select("vec_id", "first_id", F.round(T.cosine("embedding", "first"), 6).alias("cosine"))


def looks_tabular(spark, d):
    """Documents with three blanks for every comma, so that some lines have cells."""
    return _documents(spark, d, "doc_id", T.looks_tabular(F.regexp_replace("text", ", ?", "   ")).alias("tabular"))


QUERIES = {f.__name__: f for f in (
    tokenize, normalize_text, normalize_ws, cleaning_stats, strip_markdown, gibberish_flag, split_claims, nli_claims, metric_tokens, content_hash, source_digest, page_set_digest,
    context_header, truncate_ellipsis, parse_citations, expansion_parse, softmax_rows, verhoeff, choice_parse, cosine_pairs, looks_tabular, metadata_coerce, mc_prompt,
)}


def tok(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+(?:[.,][0-9]+)*')"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def squash(c: str) -> str:
    return strip(rf"regexp_replace(lower(coalesce({c}, '')), '\s+', ' ', 'g')")


def mtok(c: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({squash(c)}, '[a-z0-9$%.]+'), lambda t: regexp_replace(t, '\.+$', '')), lambda t: t <> '')"


def tidy(c: str) -> str:
    t = rf"replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = rf"regexp_replace(regexp_replace({t}, '[\x{{00ad}}\x{{200b}}\x{{200c}}\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
    t = rf"regexp_replace({t}, '([A-Za-z])-\n([a-z])', '\1\2', 'g')"
    t = rf"list_filter(list_transform(string_split({t}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
    return rf"regexp_replace(array_to_string({t}, chr(10)), '[ \t]+', ' ', 'g')"


def claims(c: str) -> str:
    t = rf"regexp_replace(replace(coalesce({c}, ''), chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g')"
    return rf"list_filter(list_transform(string_split({t}, chr(1)), lambda p: {strip('p')}), lambda p: p <> '')"


def values(rows, columns: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(lit, v)) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({columns})"


def _markdown_sql(t: str) -> str:
    """The chain without look-around: marks at both ends of every run of stars tell single ones apart."""
    for pattern, to in T.MARKDOWN:
        if pattern == T.ITALIC:
            marked = rf"regexp_replace({t}, '(\*+)', chr(1) || '\1' || chr(1), 'g')"
            t = rf"replace(regexp_replace({marked}, '\x01\*\x01([^*\n\x01]+)\x01\*\x01', '\1', 'g'), chr(1), '')"
        else:
            t = f"regexp_replace({t}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return t


_W = "string_split(text, ' ')"
_MARKED = (
    f"concat('## ', coalesce({_W}[1], 'x'), chr(10) || '- ', coalesce({_W}[2], 'x'), ' *', coalesce({_W}[3], 'x'), '* *', coalesce({_W}[4], 'x'), '* **', coalesce({_W}[5], 'x'), '** a*b' || chr(10) || '- 5 `', coalesce({_W}[6], 'x'), "
    "'` [l](u) ![i](v)' || chr(10) || '---' || chr(10) || '```py' || chr(10) || '| a | b |' || chr(10) || '|---|:--|' || chr(10), text)"
)
_LINES = rf"list_filter(list_transform(string_split(regexp_replace(text, ', ?', '   ', 'g'), chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
_MULT = "[" + ", ".join(map(str, T.DIHEDRAL)) + "]"
_PERM = "[" + ", ".join(map(str, T.PERMUTATIONS)) + "]"

SQL = {
    "tokenize": f"SELECT doc_id, len({tok('text')})::INT AS n_tokens, len(list_distinct({tok('text')}))::INT AS n_distinct, md5(array_to_string({tok('text')}, ' ')) AS token_md5 FROM documents",
    "normalize_text": f"SELECT doc_id, md5({tidy('text')}) AS clean_md5 FROM documents",
    "normalize_ws": f"SELECT doc_id, md5({tidy('text')}) AS clean_md5, length({tidy('text')})::INT AS clean_chars FROM documents",
    "cleaning_stats": f"SELECT doc_id, length(text)::INT AS raw_chars, length({tidy('text')})::INT AS clean_chars, round(length({tidy('text')}) / length(text), 6) AS ratio FROM documents",
    "strip_markdown": f"SELECT doc_id, md5({_markdown_sql(_MARKED)}) AS plain_md5 FROM documents",
    "gibberish_flag": rf"""
WITH c AS (SELECT doc_id, {tidy('text')} AS t FROM documents),
r AS (SELECT doc_id, t, length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) / nullif(length(regexp_replace(t, '\s', '', 'g')), 0) AS a FROM c)
SELECT doc_id, round(a, 6) AS alnum_ratio, length(t) >= 100 AND coalesce(a < 0.5, TRUE) AS gibberish, length(t) >= 100 AS sufficient FROM r""",
    "split_claims": f"SELECT doc_id, len({claims('text')})::INT AS n_claims, md5(array_to_string({claims('text')}, '|')) AS claims_md5 FROM documents",
    "metric_tokens": f"SELECT doc_id, len({mtok('text')})::INT AS n_tokens, md5(array_to_string({mtok('text')}, ' ')) AS token_md5 FROM documents",
    "content_hash": f"SELECT doc_id, sha256(text) AS content_hash, sha256(lower({tidy('text')})) AS chunk_key FROM documents",
    "page_set_digest": f"SELECT conv_id, sha256(string_agg({tidy('text')}, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "source_digest": f"""SELECT source, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest
FROM (SELECT source, doc_id // 512 AS b, sha256(string_agg(sha256({tidy('text')}), chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY ALL) GROUP BY source""",
    "nli_claims": rf"""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda p: {strip('p')}),
  lambda p: p <> '' AND len(string_split_regex(p, '\s+')) >= 2) AS c FROM documents) SELECT doc_id, len(c)::INT AS n_claims, md5(array_to_string(c, '|')) AS claims_md5 FROM c""",
    "metadata_coerce": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_totalprice, (o_orderkey % 2 = 0)::INT AS flag, o_custkey::VARCHAR || '|' || o_orderkey::VARCHAR AS ids FROM orders",
    "mc_prompt": """SELECT doc_id, md5('Question: Which of document ' || doc_id || '?' || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. ' || lang || chr(10) || 'B. ' || source || chr(10) || 'C. ' || substring(text, 1, 20)
  || chr(10) || chr(10) || 'Reply with only the letter of the single best answer.') AS prompt_md5 FROM documents""",
    "context_header": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Title ' || lang ELSE source || '.v1' END || ' · page ' || doc_id AS header FROM documents",
    "truncate_ellipsis": r"SELECT conv_id, turn, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substring(text, 1, 59), '\s+$', '') || '…' END AS short FROM conversations",
    "parse_citations": rf"""
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN text ELSE text || ' (Files\sub/' || upper(source) || '.PDF, p.' || doc_id % 17 || ') (x, ' || lang || ', Page ' || doc_id % 90 || ')(b.txt,p ' || doc_id % 5 || ') (open, p.7 ' END AS answer FROM documents),
m AS (SELECT doc_id, regexp_extract_all(answer, '{T.CITATION}', 1) AS names, regexp_extract_all(answer, '{T.CITATION}', 2) AS nums FROM a),
e AS (SELECT doc_id, unnest(range(len(names))) AS n, names, nums FROM m)
SELECT doc_id, n::INT AS n, lower({strip("string_split(regexp_replace(replace(names[n + 1], chr(92), '/'), '/+$', ''), '/')[-1]")}) AS document, nums[n + 1]::INT AS page FROM e""",
    "expansion_parse": rf"""
WITH t AS (SELECT conv_id, turn, text, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS w FROM conversations),
r AS (SELECT conv_id, turn, text, concat('1. ', array_to_string(w[1:4], ' '), chr(10) || '- ' || chr(39), translate(array_to_string(w[1:4], ' '), '{LETTERS}', '{LETTERS.upper()}'), chr(39) || chr(10) || chr(10) || '* "', array_to_string(w[2:4], ' '), '"' || chr(10) || '  ' || chr(10) || '12. ',
  replace(array_to_string(w[2:4], ' '), ' ', '   '), chr(10) || chr(8226) || ' ', array_to_string(w[3:7], ' '), chr(10), text, chr(10) || 'last one') AS reply FROM t),
lines AS (SELECT conv_id, turn, text, ord, {strip(strip(strip('line')))} AS line FROM (
    SELECT conv_id, turn, text, generate_subscripts(l, 1) AS ord, regexp_replace(unnest(l), '^\s*(?:[-*+\x{{2022}}]\s*|[0-9]+\.\s*)?', '') AS line
    FROM (SELECT conv_id, turn, text, string_split(reply, chr(10)) AS l FROM r))),
bare AS (SELECT conv_id, turn, text, ord, regexp_replace(regexp_replace(line, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') AS line FROM lines),
once AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, {squash('line')} ORDER BY ord) AS k FROM bare WHERE line <> '' AND {squash('line')} <> {squash('text')}),
numbered AS (SELECT conv_id, turn, line, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord) - 1 AS n FROM once WHERE k = 1)
SELECT conv_id, turn, n::INT AS n, line AS variant FROM numbered WHERE n < 3""",
    "softmax_rows": """
WITH e AS (SELECT vec_id, embedding[1:3]::DOUBLE[] AS a FROM embeddings), x AS (SELECT vec_id, list_transform(a, lambda v: exp(v - list_max(a))) AS a FROM e)
SELECT vec_id, round(a[1] / list_sum(a), 6) AS p0, round(a[2] / list_sum(a), 6) AS p1, round(a[3] / list_sum(a), 6) AS p2 FROM x""",
    "verhoeff": f"""
WITH RECURSIVE v0 AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN '12x' || doc_id WHEN doc_id % 13 = 0 THEN '' ELSE (doc_id * 7919 + 234567890124)::VARCHAR END AS digits FROM documents),
w AS (SELECT id, reverse(digits) AS s, 0 AS i, 0 AS c FROM v0 WHERE regexp_full_match(digits, '[0-9]+')
  UNION ALL SELECT id, s, i + 1, {_MULT}[c * 10 + {_PERM}[(i % 8) * 10 + s[i + 1]::INT + 1] + 1] FROM w WHERE i < length(s))
SELECT v0.id AS doc_id, coalesce(w.c = 0, FALSE) AS valid FROM v0 LEFT JOIN w ON w.id = v0.id AND w.i = length(w.s)""",
    "choice_parse": rf"""
WITH r AS (SELECT conv_id, turn, [role, substring(text, 1, 12), 'None of These'] AS choices, CASE conv_id % 4 WHEN 0 THEN 'The answer is ' || chr((65 + turn % 5)::INT) || '.' WHEN 1 THEN translate(substring(text, 1, 12), '{LETTERS}', '{LETTERS.upper()}')
  WHEN 2 THEN '(' || chr((65 + turn % 5)::INT) || ')' ELSE 'none  of these' END AS reply FROM conversations),
a AS (SELECT conv_id, turn, reply, choices, regexp_extract(reply, '(?:^|[^A-Za-z])([A-Z])(?:[^A-Za-z]|$)', 1) AS l FROM r),
b AS (SELECT conv_id, turn, choices, CASE WHEN l <> '' THEN ascii(l) - ascii('A') END AS pos, list_position(list_transform(choices, lambda x: {squash('x')}), {squash('reply')}) - 1 AS t FROM a)
SELECT conv_id, turn, (CASE WHEN pos >= 0 AND pos < len(choices) THEN pos WHEN t >= 0 THEN t END)::INT AS choice FROM b""",
    "cosine_pairs": """
WITH f AS (SELECT label, min(vec_id) AS first_id FROM embeddings GROUP BY label)
SELECT e.vec_id, f.first_id, round(list_dot_product(e.embedding::DOUBLE[], g.embedding::DOUBLE[]) /
  (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(g.embedding::DOUBLE[], g.embedding::DOUBLE[]))), 6) AS cosine
FROM embeddings e JOIN f USING (label) JOIN embeddings g ON g.vec_id = f.first_id""",
    "looks_tabular": rf"""
WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents)
SELECT doc_id, len(l) >= 2 AND len(list_filter(l, lambda x: len(string_split_regex(x, '\s{{2,}}')) >= 3)) >= greatest(2, CASE WHEN len(l) % 4 = 1 THEN (len(l) - 1) / 2 ELSE (len(l) + 1) // 2 END) AS tabular FROM l""",
}


def typed(sql: str, **casts: str) -> str:
    """``sql`` with columns cast to the types that the engine gives."""
    return f"SELECT * REPLACE ({', '.join(f'{c}::{t} AS {c}' for c, t in casts.items())}) FROM ({sql})"
