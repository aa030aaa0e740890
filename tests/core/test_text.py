import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.redact import luhn_ok, verhoeff_ok


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([[value]], f"v {kind}").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("ﬁnance  １２", "finance 12"), ("a­b​c﻿", "abc"), ("loan ac-\ncount", "loan account"), ("A-\nB", "A-\nB"), ("  x \r\n\r\n y\t z \r", "x\ny z"), ("a\x00b\x0bc", "abc"), ("", ""), ("a b", "a b"),
    ],
)
def test_normalize(spark, raw, clean):
    got = one(spark, raw, T.normalize("v"))
    assert got == clean and one(spark, got, T.normalize("v")) == got  # idempotent


def test_normalize_null(spark):
    assert one(spark, None, T.normalize("v")) == ""


@pytest.mark.parametrize(
    ("raw", "plain"),
    [
        ("# Head\ntext", "Head\ntext"), ("**bold** and *it*", "bold and it"), ("`code` [label](http://x) ![alt](y)", "code label "), ("- item\n- 5 stays", "item\n- 5 stays"),
        ("|a|b|\n|---|---|\n| c | d |", "a|b\n\nc | d"), ("IN_LOAN_NO snake_case", "IN_LOAN_NO snake_case"), ("```py\nx\n```", "\nx\n"), ("---", ""),
    ],
)
def test_strip_markdown(spark, raw, plain):
    assert one(spark, raw, T.strip_markdown("v")) == plain


def test_tokens(spark):
    assert one(spark, "Rate 10.5%, ₹1,250.00 NO-2 Über ब्याज", T.tokens("v"))[:6] == ["rate", "10.5", "1,250.00", "no", "2", "über"]
    assert one(spark, "Costs $5.50. End.", T.metric_tokens("v")) == ["costs", "$5.50", "end"]


def test_claims_keep_decimals(spark):
    assert one(spark, "It is 37.05 percent. Yes!  And\nmore? ", T.claims("v")) == ["It is 37.05 percent.", "Yes!", "And more?"]


@pytest.mark.parametrize(("t", "n", "want"), [("short", 10, "short"), ("0123456789", 10, "0123456789"), ("0123 56789x", 6, "0123…"), ("abc", 1, "…"), (None, 3, "")])
def test_ellipsis(spark, t, n, want):
    assert one(spark, t, T.ellipsis("v", n)) == want


@pytest.mark.parametrize(("name", "want"), [("a/b/c.txt", "c"), ("c.tar.gz", "c.tar"), ("dir\\x.pdf", "x"), (".env", ".env")])
def test_stem(spark, name, want):
    assert one(spark, name, T.stem("v")) == want


def test_checksums(spark):
    for digits in ("234567890124", "234567890125", "2363", "12345"):
        assert one(spark, digits, T.verhoeff("v")) == verhoeff_ok(digits)
    assert verhoeff_ok("2363") and not verhoeff_ok("2364") and luhn_ok("4111 1111 1111 1111") and not luhn_ok("4111 1111 1111 1112")


def test_softmax_and_cosine(spark):
    got = one(spark, [1000.0, 1000.0, -1000.0], T.softmax("v"), "array<double>")
    assert got == pytest.approx([0.5, 0.5, 0.0])
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(T.cosine("a", "b")).collect()] == pytest.approx([0.96, 0.0])


def test_gibberish(spark):
    assert one(spark, "#$% " * 50, T.is_gibberish("v")) and not one(spark, "word " * 50, T.is_gibberish("v")) and not one(spark, "#$%", T.is_gibberish("v"))


def test_nfkc_matches_the_library(spark):
    s = "".join(chr(c) for c in range(0xFB00, 0xFB07)) + "①ｶﾞ"
    assert one(spark, s, T.nfkc(F.col("v"))) == unicodedata.normalize("NFKC", s)
