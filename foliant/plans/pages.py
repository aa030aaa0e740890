"""Queries of pages, chunks, tables and the web."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import chunk as C
from foliant.operators import extract as X
from foliant.plans.text import strip, tidy
from foliant.sources import files, rows, web
from foliant.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents")


def _sections():
    return F.filter(F.transform(F.split("text", "\n"), lambda x: T.strip(x)), lambda x: x != "")


def text_sections(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(_sections()).alias("n", "section")).select("doc_id", "n", F.md5("section").alias("section_md5"))


def greedy_pages(spark, d):
    pages = docs(spark, d).select("doc_id", F.posexplode(C.greedy_pages(_sections())).alias("page", "sections"))
    return pages.select("doc_id", "page", F.size("sections").alias("n_sections"), F.length(F.array_join("sections", "\n\n")).alias("n_chars"))


def hard_split_windows(spark, d):
    w = docs(spark, d).select("doc_id", F.posexplode(C.windows(F.col("text"))).alias("n", "w"))
    return w.select("doc_id", "n", F.md5("w").alias("window_md5"))


def chunk_documents(spark, d):
    c = C.chunk_table(docs(spark, d), "source", "doc_id", "text")
    return c.select("chunk_id", "document_id", "page_number", "chunk_number", "content")


def chunk_stats(spark, d):
    c = C.chunk_table(docs(spark, d), "source", "doc_id", "text")
    n = F.length("content")
    return c.groupBy("document_id").agg(F.count("*").alias("chunks"), F.round(F.avg(n), 4).alias("mean_chars"), F.median(n).alias("median_chars"), F.max(n).alias("max_chars"))


def chunk_sentences(spark, d):
    """Whole sentences packed to a soft target, sizes in words."""
    c = C.chunk_table(docs(spark, d), "source", "doc_id", "text", size=120, overlap=20, target=90, sentences=True, measure="words")
    return c.select("chunk_id", F.size(F.split("content", r"\s+")).alias("words"), F.md5("content").alias("content_md5"))


def table_row_pages(spark, d):
    c = table(spark, d, "customer")
    line = rows.record(F.array(*map(F.lit, ("name", "segment", "nation"))), F.array("c_name", "c_mktsegment", F.col("c_nationkey").cast("string")))
    first = c.agg(F.min("c_custkey")).scalar()
    pages = rows.pages(c.select((F.col("c_custkey") - first + 1).alias("n"), line.alias("line")), "n", "line")
    return pages.select("page_number", F.md5("content").alias("content_md5"))


def table_render(spark, d):
    """Nations of a region as a sheet: a header, a line of dashes, padded cells, an empty row, short rows; regions past the third have a header alone."""
    n = table(spark, d, "nation")
    row = F.array(F.concat(F.lit(" "), "n_name", F.lit(" ")), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey").cast("string")), F.when(F.col("n_nationkey") % 4 == 0, ""))
    cells = n.where("n_regionkey < 3").select(F.col("n_regionkey").alias("t"), (F.col("n_nationkey") + 10).alias("n"), F.when(F.col("n_nationkey") % 5 == 4, F.slice(row, 1, 1)).otherwise(row).alias("cells"))
    fixed = lambda at, *c: table(spark, d, "region").select(F.col("r_regionkey").alias("t"), F.lit(at).cast("long").alias("n"), F.array(*map(F.lit, c)).alias("cells"))
    every = cells.union(fixed(1, "Name", "Key", "More")).union(fixed(2, "---", ":-:", "")).union(fixed(3, "", " ", ""))
    return rows.render(every, "t", "n", "cells").select("table", F.array_join("lines", "\n").alias("lines"))


def merged_cells(spark, d):
    """Suppliers as a sheet of four columns, every third cell blank, with merged ranges down and across."""
    k = F.col("s_suppkey")
    one = table(spark, d, "supplier").select(F.concat(F.lit("sheet"), (k % 3).cast("string")).alias("sheet"), F.expr("s_suppkey div 12").cast("int").alias("row"), (F.expr("s_suppkey div 3") % 4).cast("int").alias("col"), F.when(k % 5 < 2, "").otherwise(F.col("s_name")).alias("value"))
    ranges = one.where("col = 0 and row % 3 = 0").select("sheet", F.col("row").alias("top"), F.col("col").alias("left"), (F.col("row") + 1).alias("bottom"), (F.col("col") + 1).alias("right"))
    return rows.fill_merged(one, ranges)


def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", web.title(F.col("html"), F.col("url")).alias("title"))


def html_links(spark, d):
    return web.links(table(spark, d, "pages"))


def html_main_text(spark, d):
    return table(spark, d, "pages").select("page_id", web.main_text(F.col("html")).alias("content"))


def site_document_id(spark, d):
    return table(spark, d, "pages").select("page_id", web.site_id(F.col("url")).alias("site_id"))


def validate_url(spark, d):
    """URLs of pages, and what becomes of them with another scheme, a user, a private or a missing host."""
    k, rest = F.col("page_id") % 8, F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")
    made = F.when(k == 0, F.concat(F.lit("HTTP://Example.com"), rest)).when(k == 1, F.concat(F.lit("ftp://example.com"), rest)).when(k == 2, F.concat(F.lit("http://127.0.0."), (F.col("page_id") % 250).cast("string"), rest))
    made = made.when(k == 3, F.concat(F.lit("https://user@192.168.1.1:80"), rest)).when(k == 4, F.concat(F.lit("http://"), rest)).when(k == 5, F.concat(F.lit("https://172."), (F.col("page_id") % 60).cast("string"), F.lit(".1.1"), rest))
    made = made.when(k == 6, F.concat(F.lit("http://[::1]"), rest)).otherwise(F.concat(F.lit("mailto:a@b.c"), rest))
    p = table(spark, d, "pages")
    every = p.select("page_id", F.lit(False).alias("made"), "url").union(p.select("page_id", F.lit(True), made))
    return every.select("page_id", "made", web.is_safe(F.col("url")).alias("safe"))


def _graph(spark, d):
    """Each page links to two others, and to what its own links name."""
    p = table(spark, d, "pages")
    n = p.agg(F.count("*")).scalar()
    to = lambda e: p.select(F.col("url").alias("src"), F.pmod(F.expr(e), n).alias("page_id")).join(p.select("page_id", F.col("url").alias("dst")), "page_id").select("src", "dst")
    own = web.links(p).join(p.select("page_id", "url"), "page_id").select(F.col("url").alias("src"), F.col("link").alias("dst"))
    return to("page_id * 2 + 1").union(to("page_id * 3 + 2")).union(own)


def crawl_bfs(spark, d):
    """Forty pages from the first one on; on hosts of every fifth page one language is forbidden, but for page two of it."""
    p = table(spark, d, "pages")
    hosts = p.where("page_id % 5 = 0").select(web.host(F.col("url")).alias("host")).distinct()
    rules = hosts.select("host", F.lit("/de/").alias("path"), F.lit(False).alias("allow")).union(hosts.select("host", F.lit("/de/2"), F.lit(True)))
    return web.crawl(_graph(spark, d), p.where("page_id = 0").select("url"), 40, rules=rules)


def crawl_same_host(spark, d):
    """What the first page's host links to, three levels deep."""
    return web.crawl(_graph(spark, d), table(spark, d, "pages").where("page_id = 0").select("url"), 1000, same_host=True, depth=3)


def extractor_cascade(spark, d):
    """The first extraction with enough text that is not noise; engines in order of cost."""
    ascii_only, stripped = F.regexp_replace("text", r"[^\x00-\x7F]", ""), T.normalize("text")
    plain = (F.length(ascii_only) >= 100) & (F.length(ascii_only) * 1.0 / F.length("text") > 0.99)
    chosen = X.cascade({"plain": (ascii_only, plain), "layout": (stripped, X.is_good(stripped)), "ocr": (F.col("text"), F.lit(True))}, "ocr")
    return docs(spark, d).withColumn("c", chosen).select("doc_id", "c.engine", F.length("c.text").alias("n_chars"))


def supported_files(spark, d):
    """Paths made of ids and sources, with extensions of every kind."""
    endings = ("PDF", ".txt", ".tar.gz", "", ".XLSX", "/.hidden", ".jpeg", ".exe", ".md", ".docx.bak")
    path = F.concat("source", F.lit("/v1.2\\"), F.col("doc_id").cast("string"), F.get(F.array(*map(F.lit, endings)), (F.col("doc_id") % len(endings)).cast("int")))
    r = docs(spark, d).select("doc_id", path.alias("path"))
    return r.select("doc_id", files.extension(F.col("path")).alias("ext"), files.is_supported(F.col("path")).alias("supported"))


def decode_text(spark, d):
    """Documents as Latin-1 bytes where they fit it, as UTF-8 elsewhere, read back."""
    fits = ~F.col("text").rlike(r"[^\x00-\xFF]")
    content = F.when(fits & (F.col("doc_id") % 2 == 0), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return docs(spark, d).select("doc_id", F.md5(files.decoded(content)).alias("text_md5"))


QUERIES = {f.__name__: f for f in (
    text_sections, greedy_pages, hard_split_windows, chunk_documents, chunk_stats, chunk_sentences, table_row_pages, table_render, merged_cells, html_title, html_links,
    html_main_text, site_document_id, validate_url, crawl_bfs, crawl_same_host, extractor_cascade, supported_files, decode_text,
)}

_S = rf"list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
_CLEAN = "list_transform(cells, lambda x: trim(coalesce(x, '')))"

_HREF = web.HREF.replace("'", "''")
_DOTS = "list_reduce(list_prepend('', string_split(substring(p, 2), '/')), lambda done, x: CASE x WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN '.' THEN done ELSE done || '/' || x END) || CASE WHEN string_split(substring(p, 2), '/')[-1] IN ('.', '..') THEN '/' ELSE '' END"
_LINKS = rf"""
lt AS (SELECT page_id, url, (unnest(range(len(h))))::INT AS n, {strip("regexp_replace(unnest(h), '^[" + chr(34) + "'']|[" + chr(34) + "'']$', '', 'g')")} AS h FROM (SELECT page_id, url, regexp_extract_all(html, '{_HREF}', 1) AS h FROM pages)),
lp AS (SELECT *, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS root, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(h, '^([^?#]*)', 1) AS own, regexp_replace(h, '^[^?#]*', '') AS rest FROM lt),
ld AS (SELECT *, CASE WHEN starts_with(h, '/') THEN own ELSE CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || own END AS p FROM lp),
la AS (SELECT page_id, url, n, regexp_replace(CASE WHEN h = '' THEN NULL WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || h
  WHEN starts_with(h, '#') THEN url WHEN starts_with(h, '?') THEN root || path || h ELSE root || {_DOTS} || rest END, '#.*$', '') AS link FROM ld),
links AS (SELECT page_id, url, n, link FROM la WHERE regexp_matches(link, '^(?i:https?)://[^/?#]+'))"""
_EDGES = """
e AS (SELECT a.url AS src, b.url AS dst FROM pages a JOIN pages b ON b.page_id = (a.page_id * 2 + 1) % (SELECT count(*) FROM pages) UNION SELECT a.url, b.url FROM pages a JOIN pages b ON b.page_id = (a.page_id * 3 + 2) % (SELECT count(*) FROM pages)
  UNION SELECT url, link FROM links)"""


def _visible(html: str) -> str:
    """Comments and hidden elements out, a line for each block, other tags out, references of the tables' pages resolved."""
    t = f"regexp_replace({html}, '(?is)<!--.*?-->|<![^>]*>', '', 'g')"
    for tag in sorted(web._Visible.SKIP):
        t = rf"regexp_replace({t}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>', '', 'g')"
    t = rf"regexp_replace({t}, '(?is)</?(?:{'|'.join(sorted(web._Visible.BLOCK))})(?:\s[^>]*)?/?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?is)</?[a-z][^>]*>', '', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        t = f"replace({t}, '&{name};', '{char}')"
    return t


def _host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))"


def _path(url: str) -> str:
    return f"regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1)"


def _chunk_ctes(size: int, overlap: int, target: int, words: bool = False, sentences: bool = False) -> str:
    """The chunker as a tree of texts: cut level by level on the way down, joined level by level on the way up.

    CTE chunks(doc_id, source, chunks): the joined pieces are folded one by one, with what is held and whether any of it is new."""
    count = rf"(CASE WHEN {strip('@')} = '' THEN 0 ELSE len(string_split_regex({strip('@')}, '\s+')) END)"
    measure = lambda x: count.replace("@", x) if words else f"length({x})"
    joined = lambda x, sep: f"coalesce(list_sum(list_transform({x}, lambda z: {measure('z')})), 0) + {0 if words else len(sep)} * greatest(len({x}) - 1, 0)"
    quoted = lambda sep: "'" + sep.replace("\n", "' || chr(10) || '") + "'"
    levels = [(f"string_split(text, {quoted(sep)})", sep) for sep in C.SEPARATORS]
    if sentences:
        levels.insert(0, (r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))", " "))
    out, keys = [f"n1 AS (SELECT doc_id, source, 1 AS k1, text FROM (SELECT doc_id, source, {strip('text')} AS text FROM documents) WHERE text <> '')"], ["doc_id", "source", "k1"]
    for i, (split, _) in enumerate(levels, 1):
        out.append(f"p{i} AS (SELECT *, CASE WHEN {measure('text')} > {size} THEN list_filter({split}, lambda x: {strip('x')} <> '') END AS parts FROM n{i})")
        out.append(f"n{i + 1} AS (SELECT {', '.join(keys)}, unnest(range(len(l))) AS k{i + 1}, unnest(l) AS text FROM (SELECT *, CASE WHEN len(parts) > 1 THEN parts ELSE [text] END AS l FROM p{i}))")
        keys.append(f"k{i + 1}")
    n = len(levels) + 1
    windows = f"CASE WHEN {measure('text')} <= {size} THEN [text] ELSE list_transform(range(0, length(text), {size - overlap}), lambda i: substring(text, (i + 1)::BIGINT, {size})) END"
    out.append(f"c{n} AS (SELECT {', '.join(keys)}, {windows} AS chunks FROM n{n})")
    for i in range(len(levels), 0, -1):
        last, sep = keys.pop(), levels[i - 1][1]
        on = ", ".join(keys)
        too_long = f"len(a.held) > 0 AND {joined('list_append(a.held, x.p)', sep)} > {size}"
        shut = lambda held, sep=sep: f"list_append(a.out, array_to_string({held}, {quoted(sep)}))"
        carry = lambda held, sep=sep: f"coalesce({held}[nullif(list_filter(range(len({held}) + 1), lambda k: {joined(f'{held}[(k + 1):]', sep)} <= {overlap})[1], 0) + 1:], [])"
        fits = lambda held, sep=sep: f"{held}[list_filter(range(len({held}) + 1), lambda k: {joined(f'list_append({held}[(k + 1):], x.p)', sep)} <= {size} OR k = len({held}))[1] + 1:]"
        # a: what stands before piece x; b: after closing where x is too much; then x is added, and the target may close again.
        step = f"{{'p': x.p, 'out': CASE WHEN {too_long} AND a.fresh > 0 THEN {shut('a.held')} ELSE a.out END, 'held': CASE WHEN {too_long} AND a.fresh > 0 THEN {carry('a.held')} ELSE a.held END, 'fresh': CASE WHEN {too_long} THEN 0 ELSE a.fresh END}}"
        add = f"{{'p': a.p, 'out': a.out, 'held': list_append(CASE WHEN {too_long} THEN {fits('a.held')} ELSE a.held END, x.p), 'fresh': a.fresh + 1}}"
        done = f"{joined('a.held', sep)} >= {target}"
        end = f"{{'p': a.p, 'out': CASE WHEN {done} THEN {shut('a.held')} ELSE a.out END, 'held': CASE WHEN {done} THEN {carry('a.held')} ELSE a.held END, 'fresh': CASE WHEN {done} THEN 0 ELSE a.fresh END}}"
        phases = [("step", step), ("add", add)] + ([("end", end)] if target < size else [])
        # Each piece stands once for each phase, in order.
        items = "flatten(list_transform(pieces, lambda p: [" + ", ".join(f"{{'ph': '{name}', 'p': p, 'out': []::VARCHAR[], 'held': []::VARCHAR[], 'fresh': 0}}" for name, _ in phases) + "]))"
        with_phase = lambda body: body.replace("{'p':", "{'ph': x.ph, 'p':", 1)
        fold = "CASE x.ph " + " ".join(f"WHEN '{name}' THEN {with_phase(body)}" for name, body in phases) + " END"
        start = "{'ph': '', 'p': '', 'out': []::VARCHAR[], 'held': []::VARCHAR[], 'fresh': 0}"
        out.append(f"g{i} AS (SELECT {on}, flatten(list(chunks ORDER BY {last})) AS pieces, count(*) AS n FROM c{i + 1} GROUP BY {on})")
        out.append(f"f{i} AS (SELECT {on}, n, pieces, CASE WHEN n > 1 THEN list_reduce(list_prepend({start}, {items}), lambda a, x: {fold}) END AS r FROM g{i})")
        out.append(f"c{i} AS (SELECT {on}, CASE WHEN n = 1 THEN pieces WHEN len(r.held) > 0 AND r.fresh > 0 THEN list_append(r.out, array_to_string(r.held, {quoted(sep)})) ELSE r.out END AS chunks FROM f{i})")
    return ", ".join(out)


_CHUNKS = f"""{_chunk_ctes(400, 80, 400)},
chunks AS (SELECT source AS document_id, doc_id AS page_number, unnest(range(1, len(chunks) + 1))::INT AS chunk_number, unnest(chunks) AS content FROM c1)"""

SQL = {
    "chunk_documents": f"WITH {_CHUNKS} SELECT document_id || '_p' || page_number || '_c' || chunk_number AS chunk_id, document_id, page_number, chunk_number, content FROM chunks",
    "chunk_stats": f"WITH {_CHUNKS} SELECT document_id, count(*) AS chunks, round(avg(length(content)), 4) AS mean_chars, median(length(content))::DOUBLE AS median_chars, max(length(content))::INT AS max_chars FROM chunks GROUP BY document_id",
    "chunk_sentences": f"""WITH {_chunk_ctes(120, 20, 90, words=True, sentences=True)}, chunks AS (SELECT source, doc_id, unnest(range(1, len(chunks) + 1)) AS n, unnest(chunks) AS content FROM c1)
SELECT source || '_p' || doc_id || '_c' || n AS chunk_id, len(string_split_regex(content, '\\s+'))::INT AS words, md5(content) AS content_md5 FROM chunks""",
    "text_sections": f"SELECT doc_id, (unnest(range(len(s))))::INT AS n, md5(unnest(s)) AS section_md5 FROM (SELECT doc_id, {_S} AS s FROM documents)",
    "greedy_pages": f"""
WITH RECURSIVE s AS (SELECT doc_id, {_S} AS s FROM documents),
w AS (
  SELECT doc_id, s, 0 AS i, 0 AS page, 0 AS held, 0 AS size, 0 AS loc FROM s WHERE len(s) > 0
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN ovr THEN page + 1 ELSE page END + prior, CASE WHEN ovr OR prior = 1 THEN 1 ELSE held + 1 END,
    CASE WHEN ovr OR prior = 1 THEN 0 ELSE size END + length(s[i + 1]) + 2, CASE WHEN ovr THEN page + 1 ELSE page END + prior
  FROM (SELECT *, CASE WHEN size >= 2000 THEN 1 ELSE 0 END AS prior, held > 0 AND size < 2000 AND size + length(s[i + 1]) > 2000 AS ovr FROM w WHERE i < len(s))),
p AS (SELECT doc_id, s[i] AS section, i, loc AS page FROM w WHERE i > 0)
SELECT doc_id, page::INT AS page, count(*)::INT AS n_sections, length(string_agg(section, chr(10) || chr(10) ORDER BY i))::INT AS n_chars FROM p GROUP BY doc_id, page""",
    "hard_split_windows": """
SELECT doc_id, n::INT AS n, md5(CASE WHEN length(text) <= 400 THEN text ELSE substring(text, n * 320 + 1, 400) END) AS window_md5
FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 400 THEN [0] ELSE range((length(text) - 1) // 320 + 1) END) AS n FROM documents)""",
    "table_row_pages": """
SELECT page_number, md5(string_agg('name: ' || c_name || ' | segment: ' || c_mktsegment || ' | nation: ' || c_nationkey, chr(10) ORDER BY n)) AS content_md5
FROM (SELECT *, c_custkey - (SELECT min(c_custkey) FROM customer) + 1 AS n, (c_custkey - (SELECT min(c_custkey) FROM customer)) // 50 + 1 AS page_number FROM customer) GROUP BY page_number""",
    "table_render": rf"""
WITH e AS (SELECT n_regionkey AS t, n_nationkey + 10 AS n, CASE WHEN n_nationkey % 5 = 4 THEN [' ' || n_name || ' '] ELSE [' ' || n_name || ' ', CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey::VARCHAR END, CASE WHEN n_nationkey % 4 = 0 THEN '' END] END AS cells FROM nation WHERE n_regionkey < 3
  UNION ALL SELECT r_regionkey, 1, ['Name', 'Key', 'More'] FROM region UNION ALL SELECT r_regionkey, 2, ['---', ':-:', ''] FROM region UNION ALL SELECT r_regionkey, 3, ['', ' ', ''] FROM region),
c AS (SELECT t, n, {_CLEAN} AS c FROM e),
k AS (SELECT t, n, c, row_number() OVER (PARTITION BY t ORDER BY n) AS r FROM c
  WHERE len(list_filter(c, lambda x: x <> '')) > 0 AND len(list_filter(c, lambda x: x <> '' AND NOT regexp_full_match(x, '[\s|:\-=_+]*-[\s|:\-=_+]*'))) > 0),
h AS (SELECT t, c AS header FROM k WHERE r = 1),
l AS (SELECT t, r, array_to_string(list_filter(list_transform(range(1, greatest(len(header), len(c)) + 1), lambda i: CASE WHEN coalesce(header[i], '') <> '' AND coalesce(c[i], '') <> '' THEN header[i] || ': ' || c[i] END), lambda x: x IS NOT NULL), ' | ') AS line
  FROM k JOIN h USING (t) WHERE r > 1)
SELECT t AS "table", coalesce((SELECT string_agg(line, chr(10) ORDER BY l.r) FROM l WHERE l.t = h.t AND line <> ''),
  (SELECT string_agg(array_to_string(list_filter(k.c, lambda x: x <> ''), ' | '), chr(10) ORDER BY k.r) FROM k WHERE k.t = h.t)) AS lines FROM h""",
    "merged_cells": """
WITH c AS (SELECT 'sheet' || s_suppkey % 3 AS sheet, (s_suppkey // 12)::INT AS row, ((s_suppkey // 3) % 4)::INT AS col, CASE WHEN s_suppkey % 5 < 2 THEN '' ELSE s_name END AS value FROM supplier),
r AS (SELECT sheet, row AS t, col AS l FROM c WHERE col = 0 AND row % 3 = 0),
o AS (SELECT r.sheet, r.t + i AS row, r.l + j AS col, k.value AS fill FROM r JOIN c k ON k.sheet = r.sheet AND k.row = r.t AND k.col = r.l, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j))
SELECT sheet, row, col, coalesce(nullif(c.value, ''), o.fill) AS value FROM c FULL JOIN o USING (sheet, row, col)""",
    "html_main_text": rf"""
WITH t AS (SELECT page_id, {_visible('html')} AS t FROM pages), l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip("regexp_replace(x, '[ " + chr(92) + "t]+', ' ', 'g')")}), lambda x: x <> '') AS l FROM t)
SELECT page_id, array_to_string(l, chr(10)) AS content FROM l""",
    "html_title": rf"SELECT page_id, coalesce(nullif({strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ''), url) AS title FROM pages",
    "html_links": f"WITH {_LINKS} SELECT page_id, n, link FROM links",
    "site_document_id": """
SELECT page_id, 'web_' || substring(sha1(lower(h) || substring(u, length(h) + 1)), 1, 12) AS site_id
FROM (SELECT page_id, u, regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS h FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages))""",
    "validate_url": rf"""
WITH b AS (SELECT page_id, page_id % 8 AS k, url, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS rest FROM pages),
e AS (SELECT page_id, FALSE AS made, url FROM pages UNION ALL SELECT page_id, TRUE, CASE k WHEN 0 THEN 'HTTP://Example.com' WHEN 1 THEN 'ftp://example.com' WHEN 2 THEN 'http://127.0.0.' || page_id % 250 WHEN 3 THEN 'https://user@192.168.1.1:80' WHEN 4 THEN 'http://'
  WHEN 5 THEN 'https://172.' || page_id % 60 || '.1.1' WHEN 6 THEN 'http://[::1]' ELSE 'mailto:a@b.c' END || rest FROM b),
h AS (SELECT page_id, made, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)', 1)), '^\[|\]$', '', 'g') AS bare FROM e)
SELECT page_id, made, regexp_matches(url, '^(?i:https?)://') AND bare <> '' AND NOT regexp_matches(bare, '{web.PRIVATE}') AS safe FROM h""",
    "crawl_bfs": f"""
WITH RECURSIVE {_LINKS}, {_EDGES}, d AS (SELECT DISTINCT {_host('url')} AS h FROM pages WHERE page_id % 5 = 0),
ok AS (SELECT DISTINCT dst, NOT ({_host('dst')} IN (SELECT h FROM d) AND starts_with({_path('dst')}, '/de/') AND NOT starts_with({_path('dst')}, '/de/2')) AS ok FROM (SELECT dst FROM e UNION SELECT url FROM pages WHERE page_id = 0)),
r AS (SELECT url, 0 AS level FROM pages JOIN ok ON ok.dst = url AND ok.ok WHERE page_id = 0 UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = r.url JOIN ok ON ok.dst = e.dst AND ok.ok WHERE level < 12),
f AS (SELECT url, min(level) AS level FROM r GROUP BY url)
SELECT url, level, row_number() OVER (ORDER BY level, url)::INT AS page_number FROM f QUALIFY page_number <= 40""",
    "crawl_same_host": f"""
WITH RECURSIVE {_LINKS}, {_EDGES}, r AS (SELECT url, 0 AS level FROM pages WHERE page_id = 0 UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = r.url AND {_host('e.dst')} = (SELECT {_host('url')} FROM pages WHERE page_id = 0) WHERE level < 3),
f AS (SELECT url, min(level) AS level FROM r GROUP BY url)
SELECT url, level, row_number() OVER (ORDER BY level, url)::INT AS page_number FROM f""",
    "extractor_cascade": rf"""
WITH t AS (SELECT doc_id, text, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS a, {tidy('text')} AS s FROM documents),
e AS (SELECT *, CASE WHEN length(a) >= 100 AND length(a) / length(text) > 0.99::DOUBLE THEN 'plain'
  WHEN length(s) >= 100 AND NOT coalesce(length(regexp_replace(s, '[^\p{{L}}\p{{N}}]', '', 'g')) / nullif(length(regexp_replace(s, '\s', '', 'g')), 0) < 0.5, TRUE) THEN 'layout' ELSE 'ocr' END AS engine FROM t)
SELECT doc_id, CASE WHEN engine = 'ocr' AND {strip('text')} = '' THEN 'none' ELSE engine END AS engine, CASE WHEN engine = 'ocr' AND {strip('text')} = '' THEN 0 ELSE length(CASE engine WHEN 'plain' THEN a WHEN 'layout' THEN s ELSE text END) END::INT AS n_chars FROM e""",
    "supported_files": rf"""
WITH p AS (SELECT doc_id, source || '/v1.2\' || doc_id || (['PDF', '.txt', '.tar.gz', '', '.XLSX', '/.hidden', '.jpeg', '.exe', '.md', '.docx.bak'])[doc_id % 10 + 1] AS path FROM documents)
SELECT doc_id, lower(regexp_extract(path, '(\.[^./\\]+)$', 1)) AS ext, lower(regexp_extract(path, '(\.[^./\\]+)$', 1)) IN {files.EXTENSIONS} AS supported FROM p""",
    "decode_text": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
}
