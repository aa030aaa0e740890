"""Model inputs and their marks, gates, extraction cascades, registries, saved state, crawling and names."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import answer as A
from foliant.operators import evaluate as E
from foliant.operators import extract as X
from foliant.operators import quality as Q
from foliant.operators import redact as R
from foliant.sources import web
from foliant.streaming import state as S


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_unscrubbed_text_reaches_no_prompt(spark):
    rows = table(spark, [(1, "mail a@b.org", "c")], "query_id int, question string, context string")
    with pytest.raises(ValueError, match="question, context"):
        A.prompts(rows, "question", "context")
    once = A.scrubbed(A.scrubbed(rows, "question", R.redact), "context", R.redact)
    again = A.scrubbed(once, "question", lambda c: F.lit("never"))
    assert again is once
    out = A.prompts(again, "question", "context", "Be brief.").first()
    assert out["prompt"] == "Question: mail <EMAIL_ADDRESS>\n\nRetrieved context:\n<context>\nc\n</context>" and out["system"] == "Be brief."


def test_model_inputs_see_the_label_in_the_chunk_before(spark):
    q = table(spark, [(1, "whose a/c no")], "query_id int, text string")
    ranked = table(
        spark,
        [(1, 1, "d", "f.txt", "2", "30123456789 is old. New A/c No"), (1, 2, "d", "f.txt", "3", "40123456789 is new"), (1, 3, "d", None, None, "end"), (1, 4, None, None, "7", "bare"), (1, 5, "d", "f.txt", "2", "more")],
        "query_id int, rank int, document_id string, filename string, page_number string, content string",
    )
    whole, pages = A.model_inputs(q, ranked, R.redact_after)
    got = whole.first()
    assert got["context"].split("\n\n") == ["[Doc: f.txt | Page 2]\n<IN_ACCOUNT_NO> is old. New A/c No", "[Doc: f.txt | Page 3]\n<IN_ACCOUNT_NO> is new", "[Doc: d | Page ?]\nend", "[Page 7]\nbare", "[Doc: f.txt | Page 2]\nmore"]
    assert A.is_scrubbed(whole, "context") and A.is_scrubbed(pages, "text")
    texts = {(r["document_id"], r["page_number"]): r["text"] for r in pages.collect()}
    assert texts[("d", "2")] == "<IN_ACCOUNT_NO> is old. New A/c No\nmore"


def test_models_that_fail_leave_the_question(spark):
    rows = table(spark, [(1, "short"), (2, "fails"), (3, ""), (4, None), (5, "sim")], "id int, q string").withMetadata("q", A.MARK)

    def model(text):
        if text == "fails":
            raise RuntimeError(text)
        return {"short": ' "long form" ', "sim": "[SIMULATED] x"}.get(text, "")

    got = [r["search_text"] for r in A.standalone(rows, "q", "q", F.lit(True), model).orderBy("id").collect()]
    assert got == ["long form", "fails", "", None, "sim"]
    assert [r["search_text"] for r in A.standalone(rows, "q", "q", F.lit(True), None).orderBy("id").collect()] == ["short", "fails", "", None, "sim"]
    with pytest.raises(ValueError):
        A.standalone(rows.withColumn("raw", F.concat("q", F.lit(""))), "q", "raw", F.lit(True), model)


def test_gates_without_documents(spark):
    q = table(spark, [(1, "x", None), (2, "y", "d")], "query_id int, text string, scope string")
    none = table(spark, [], "document_id string")
    got = {r["query_id"]: r["reason"] for r in A.refused(q, none, F.lit(None).cast("string")).collect()}
    assert got == {1: A.NOTHING_UPLOADED, 2: A.NOTHING_UPLOADED}
    one = table(spark, [("e",)], "document_id string")
    assert {r["query_id"]: r["reason"] for r in A.refused(q, one, F.when(F.col("query_id") == 1, "empty")).collect()} == {1: "empty", 2: A.UNKNOWN_DOCUMENT}
    assert {r["query_id"] for r in A.unanswered(q, table(spark, [(1,)], "query_id int")).collect()} == {2}


def test_cascade_prefers_cheap_good_text(spark):
    prose, noise = "plain words " * 12, "#-" * 80
    rows = [("a", 1, prose, noise, None, "scan"), ("a", 2, "", prose, None, "scan"), ("a", 3, "", noise, None, "scan"), ("a", 4, "", "", None, " "), ("a", 5, "x  y  z\nu  v  w", "", "x | y | z", "scan"), ("a", 101, prose, "", None, "")]
    t = table(spark, rows, "document_id string, page_number int, plain string, layout string, tables string, scan string")
    got = [(r["page_number"], r["engine"]) for r in X.page_texts(t, "plain", "layout", "tables", "scan").orderBy("page_number").collect()]
    assert got == [(1, "text"), (2, "layout"), (3, "ocr"), (4, "none"), (5, "tables")]
    assert [tuple(r) for r in X.pages_left_out(t).collect()] == [("a", 1)]


def test_registry_after_removals_and_clearing(spark):
    log = table(spark, [(1, "a", "add", 1), (2, "b", "add", 2), (3, None, "clear", 0), (4, "b", "add", 3), (5, "c", "add", 4), (6, "c", "remove", 0), (7, "b", "add", 5)], "seq int, id string, op string, v int")
    got = Q.current(log, "id", "seq", removed=F.col("op") == "remove", cleared=F.col("op") == "clear").collect()
    assert [(r["id"], r["v"]) for r in got] == [("b", 5)]
    registry = table(spark, [("old", "f.pdf", 1, 1), ("x", "g.pdf", 1, 1), ("gone", "h.pdf", 1, 1)], "document_id string, filename string, pages long, chunks long")
    new = table(spark, [("new", "f.pdf"), ("x", "other.pdf")], "document_id string, filename string")
    assert sorted(map(tuple, Q.replaced_by(registry, new).collect())) == [("old", "new"), ("x", "x")]
    chunks = table(spark, [("x", "g.pdf", 1), ("y", "k.pdf", 1), ("y", "k.pdf", None), ("", "z", 1), (None, "z", 1)], "document_id string, filename string, page_number int")
    assert sorted(map(tuple, Q.restored(registry, chunks).collect())) == [("x", "g.pdf", 1, 1, "registry"), ("y", "k.pdf", 1, 2, "backfilled")]


def test_saved_quota_state(spark):
    broken = ['{"a": {"until": 1.5, "failures": 2}, "b": [1], "c": {"until": "soon"}, "d": {}}', "[]", "{oops", None]
    rows = table(spark, [(i, b) for i, b in enumerate(broken)], "i int, s string").select("i", S.sanitised(F.col("s")).alias("m")).orderBy("i").collect()
    assert {k: (v["until"], v["failures"]) for k, v in rows[0]["m"].items()} == {"a": (1.5, 2), "d": (0.0, 0)} and not any(r["m"] for r in rows[1:])
    calls = table(spark, [("p", 1, 10.0, True), ("p", 2, 11.0, False), ("p", 3, 12.0, True), ("p", 4, 13.0, True), ("q", 5, 1.0, False)], "who string, n int, at double, bad boolean")
    got = {r["who"]: (r["failures"], r["until"]) for r in S.quota_state(calls, "who", ["n"], F.col("bad"), F.lit(20.0)).collect()}
    assert got == {"p": (2, 53.0), "q": (0, 0.0)}


LINKS = (
    ("http://h.org/a/b/c?q=1", "../d", "http://h.org/a/d"), ("http://h.org/a/b/c", "../../../x/./y", "http://h.org/x/y"), ("http://h.org/a/b", "..", "http://h.org/"), ("http://h.org/a/", "./", "http://h.org/a/"),
    ("http://h.org", "x?y=../z", "http://h.org/x?y=../z"), ("http://h.org/a", "//k.org/p", "http://k.org/p"), ("http://h.org/a", "/r/../s", "http://h.org/s"), ("http://h.org/a#f", "?n=2#t", "http://h.org/a?n=2"),
)


def test_links_are_resolved_like_a_browser(spark):
    from urllib.parse import urldefrag, urljoin

    got = table(spark, [(i, b, h) for i, (b, h, _) in enumerate(LINKS)], "i int, b string, h string").select("i", web.absolute(F.col("b"), F.col("h")).alias("u")).orderBy("i").collect()
    assert [r["u"] for r in got] == [u for _, _, u in LINKS] == [urldefrag(urljoin(b, h)).url for b, h, _ in LINKS]
    html = """<a href='/one'>1</a><a class=x href=two>2</a><a data-href="no" href="three">3</a><A HREF = "mailto:x">4</a><abbr href="no">"""
    page = table(spark, [(1, "http://h.org/", html)], "page_id int, url string, html string")
    assert [r["link"] for r in web.links(page).orderBy("n").collect()] == ["http://h.org/one", "http://h.org/two", "http://h.org/three"]


def test_crawl_keeps_to_host_rules_and_reach(spark):
    chain = [(f"http://h.org/{i}", f"http://h.org/{i + 1}") for i in range(40)] + [("http://h.org/1", "http://k.org/"), ("http://h.org/2", "http://h.org/private/a"), ("http://h.org/private/a", "http://h.org/z")]
    edges, start = table(spark, chain, "src string, dst string"), table(spark, [("http://h.org/0",)], "url string")
    every = [r["url"] for r in web.crawl(edges, start, 1000).collect()]
    assert len(every) == 44 and "http://k.org/" in every  # forty levels deep
    rules = table(spark, [("H.org", "/private/", False), ("h.org", "/private/open", True)], "host string, path string, allow boolean")
    kept = {r["url"] for r in web.crawl(edges, start, 1000, same_host=True, rules=rules).collect()}
    assert len(kept) == 41 and not kept & {"http://k.org/", "http://h.org/private/a", "http://h.org/z"}
    assert web.robots_allow(table(spark, [("http://h.org/private/open/x",), ("http://q.org/private/",)], "url string"), rules).count() == 2


def test_resolver_is_asked_for_hosts_that_look_public(spark):
    urls = table(spark, [("http://good.org/",), ("http://evil.org/",), ("http://10.0.0.1/",)], "u string")

    def resolver(host):
        if host.startswith("10."):
            raise AssertionError(host)
        return host == "good.org"

    assert [r[0] for r in urls.select(web.is_safe(F.col("u"), resolver)).collect()] == [True, False, False]


@pytest.mark.parametrize(("text", "out"), [
    ("Borrower: Ramesh Kumar Gupta agreed", "Borrower: <PERSON> agreed"), ("met Sarah O. Connor today", "met <PERSON> today"), ("signed by Zyx Qwert", "signed by <PERSON>"), ("the Branch Manager said", "the Branch Manager said"), ("John said no", "John said no"),
])
def test_names_without_an_honorific(text, out):
    assert R.scrub(text) == out


def test_another_recogniser_of_names(spark):
    df = spark.createDataFrame([("xx yy zz",)], "t string")
    assert df.select(R.redact("t", persons=lambda t: [(3, 5)])).first()[0] == "xx <PERSON> zz"


def test_nothing_that_could_be_redacted_is_passed_by(spark):
    """The column test lets every text through that the recognisers change."""
    from .test_redact import HIDDEN

    texts = [t for t, _, _ in HIDDEN] + ["Dr. Alan Poe", "s/o Ram Lal", "MG Road area", "loan no: ABCDEFGH", "reference # QWERTYUI", "Borrower: Ann Lee Poe", "nothing here", "", "Yusuf Ali Khan"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", R.redact("t").alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [R.scrub(t) for t in texts]


def test_many_spans_without_overlaps():
    text = " ".join(f"mail u{i}@x.org, a/c no. {30123456789 + i}, server 10.0.{i % 200}.{i % 99}" for i in range(400))
    spans = R.find(text)
    assert len(spans) == 1200 and all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))  # noqa: B905


def test_items_without_an_inner_token_are_matched(spark):
    docs = table(spark, [(i, t) for i, t in enumerate(["alpha beta gamma", "beta", "x-y", "delta alpha", None, ""])], "doc_id int, text string")
    items = table(spark, [(0, "alpha"), (1, "beta gamma"), (2, "-"), (3, "alpha beta gamma"), (4, ""), (5, None), (6, "zeta")], "query_id int, text string")
    got = sorted((r["query_id"], r["doc_id"]) for r in E.containment(docs, items).collect())
    assert got == [(0, 0), (0, 3), (1, 0), (2, 2), (3, 0)]
