import pytest
from pyspark.sql import functions as F

from foliant.llm import op08_hosts as op

CASES = (
    (1, "http://www.Example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    (3, "https://b.www.example.com/en/1?q#f", "b.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    (4, "https://example.com/fr/", "example.com", "/fr/", "com/", "allow"),
    (5, "https://x.net/fr/1", "x.net", "/fr/1", "net/fr/", "block"),
    (6, "https://notexample.com?x=/en/", "notexample.com", "", None, "allow"),
    (7, "no scheme", "", "", None, "allow"),
    (8, None, "", "", None, "allow"),
    (9, "a://b://c/en/", "b:", "//c/en/", None, "allow"),
    (10, "http://x.net/de/", "x.net", "/de/", None, "allow"),
    (11, "", "", "", None, "allow"),
)


def test_rules(spark):
    pages = spark.createDataFrame([list(c[:2]) for c in CASES], "page_id long, url string").withColumn("bad", F.lit("x")).withColumn("n", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op.filter_urls(pages).collect()}
    assert got == {c[0]: c[2:] for c in CASES}


def test_posterior_bound_blocks_bad_hosts(spark):
    rows = [("bad.org", 1)] * 30 + [("good.org", 0)] * 40 + [("fine.com", 0)] * 20 + [("sub.bad.org", None), ("new.org", None), ("a.co.uk", 1)]
    got = {r["host"]: r for r in op.reputation(spark.createDataFrame([list(r) for r in rows], "host string, bad int")).collect()}
    assert got["bad.org"]["bound"] > 0.5 > got["good.org"]["mean"]
    assert got["sub.bad.org"]["mean"] > 0.5 > got["new.org"]["bound"]  # inherits its domain, or only the suffix
    assert got["a.co.uk"]["suffix"] == "co.uk" and got["a.co.uk"]["domain"] == "a.co.uk"


def test_shrinkage_lies_between_group_and_parent(spark):
    level = spark.createDataFrame([(f"h{i}", 10, i % 10, 0.5) for i in range(20)], "host string, n long, bad long, parent double")
    for r in op._shrunk(level, ["host"], "parent", op.Reputation()).collect():
        rate = r["bad"] / r["n"]
        assert min(rate, 0.5) - 1e-9 <= r["mean"] <= max(rate, 0.5) + 1e-9 and r["weight"] > r["n"]


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_small_tables(spark, rows):
    assert op.filter_urls(spark.createDataFrame([list(r) for r in rows], "page_id long, url string")).count() == len(rows)


def test_suffixes_and_domains(spark):
    hosts = ["a.b.co.uk", "www.x.gov.uk", "x.com.mx", "q.co.nz", "www.example.com", "m.site.de", "com", "", "co.uk", "deep.a.b.org.au", "de.co"]
    p = op.Reputation()
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("suffix", op.suffix_of(F.col("host"), p))
    got = {r["host"]: (r["suffix"], r["d"]) for r in rows.select("host", "suffix", op.domain_of(F.col("host"), F.col("suffix")).alias("d")).collect()}
    assert got == {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "www.x.gov.uk": ("gov.uk", "x.gov.uk"), "x.com.mx": ("com.mx", "x.com.mx"), "q.co.nz": ("co.nz", "q.co.nz"), "www.example.com": ("com", "example.com"),
        "m.site.de": ("de", "site.de"), "com": ("com", "com"), "": ("", ""), "co.uk": ("co.uk", "co.uk"), "deep.a.b.org.au": ("org.au", "b.org.au"), "de.co": ("co", "de.co"),
    }


def test_a_list_of_suffixes(spark, tmp_path):
    (tmp_path / "list").write_text("// remark\ncom\nuk\nco.uk  // more\n\n*.ck\n!www.ck\nBlogs.example.com\n")
    rules = op.suffix_rules(spark, str(tmp_path / "list"))
    hosts = ["a.b.co.uk", "x.y.ck", "a.www.ck", "me.blogs.example.com", "other.example.com", "no.rule", "uk", ""]
    rows = op.with_suffix(spark.createDataFrame([(h, 1) for h in hosts], "host string, n int"), rules, op.Reputation())
    assert {r["host"]: r["suffix"] for r in rows.collect()} == {
        "a.b.co.uk": "co.uk", "x.y.ck": "y.ck", "a.www.ck": "ck", "me.blogs.example.com": "blogs.example.com", "other.example.com": "com", "no.rule": "rule", "uk": "uk", "": "",
    }
    pages = spark.createDataFrame([(1, "http://a.net/es/"), (2, "http://a.net/x"), (3, "http://b.c.co.uk/")], "page_id long, url string")
    assert op.filter_urls(pages, suffixes=rules).count() == 3


def test_repeats_long_urls_and_the_bound(spark):
    """Repeated rows are judged alike, a very long url as any other, and a host at the bound itself is blocked."""
    long = "http://bad.net/es/" + "x" * 200_000
    rows = [(1, "http://bad.net/es/a")] * 30 + [(2, "http://bad.net/other"), (2, "http://bad.net/other"), (3, long), (4, None), (5, "http://good.com/x" + "?" * 100_000)]
    got = op.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["page_id"], set()).add((r["host"], r["verdict"], r["rule"]))
    assert len(got) == len(rows) and by[2] == {("bad.net", "block", None)} and by[3] == {("bad.net", "block", "net/es/")} and by[5] == {("good.com", "allow", "com/")} and len(by[4]) == 1
    bound = op.reputation(spark.createDataFrame([("h", 1)] * 3, "host string, bad int")).first()["bound"]
    tie = op.Reputation(block_at=round(bound, 9))
    pages = spark.createDataFrame([(1, "http://h/es/")] * 3 + [(2, "http://h/")], "page_id long, url string")
    said = op.filter_urls(pages, rules=(("block", "h", "/es/"),), p=tie).where("page_id = 2").first()
    assert said["verdict"] == "block"
