import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import redact as R
from foliant.streaming.state import StableScrubber, backoff

HIDDEN = (
    ("my Aadhaar is 2345 6789 0124", "AADHAAR_NUMBER", "2345 6789 0124"), ("PAN ABCDE1234F given", "PAN_NUMBER", "ABCDE1234F"), ("A/c No. 30123456789 held", "IN_ACCOUNT_NO", "30123456789"),
    ("Loan Account No. 12345678901 due", "IN_LOAN_NO", "12345678901"), ("IFSC SBIN0001234", "IFSC_CODE", "SBIN0001234"), ("UPI id: ravi.k@okbank now", "UPI_ID", "ravi.k@okbank"),
    ("write to a.b@x.org please", "EMAIL_ADDRESS", "a.b@x.org"), ("cheque no. 123456 paid", "CHEQUE_NO", "123456"), ("Policy No: LIC-998877 lapsed", "POLICY_NO", "LIC-998877"), ("Mr. Ram Nath Sharma signed", "IN_PERSON_NAME", "Mr. Ram Nath Sharma"),
    ("PIN code 226010", "IN_PINCODE", "226010"), ("card 4111 1111 1111 1111", "CREDIT_CARD", "4111 1111 1111 1111"), ("server 192.168.10.20 down", "IP_ADDRESS", "192.168.10.20"), ("GSTIN 22ABCDE1234F1Z5", "GSTIN", "22ABCDE1234F1Z5"),
)


@pytest.mark.parametrize(("text", "entity", "secret"), HIDDEN)
def test_hides(text, entity, secret):
    out = R.scrub(text)
    assert f"<{entity}>" in out and secret not in out and R.scrub(out) == out


@pytest.mark.parametrize("text", ["the amount is 450000 rupees", "dated 12 March 2024", "10.5% for 36 months", "Lucknow branch", "number 2345 6789 0125 alone"])
def test_keeps(text):
    assert R.scrub(text) == text


def test_label_stays_and_loan_wins():
    assert R.scrub("Loan A/c No. 30123456789") == "Loan A/c No. <IN_LOAN_NO>"


def test_fails_closed_open_or_drops(spark, monkeypatch):
    df = spark.createDataFrame([("a@b.org",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(R.redact("t")).collect()] == ["<EMAIL_ADDRESS>", None, ""]
    assert [r[0] for r in df.select(R.redact_for_display("t")).collect()] == [r[0] for r in df.select(R.redact_or_drop("t")).collect()]


def test_spans_have_offsets(spark):
    s = spark.createDataFrame([("é mail a@b.org",)], "t string").select(F.explode(R.detect("t")).alias("s")).select("s.*").first()
    assert (s["entity"], s["start"], s["end"]) == ("EMAIL_ADDRESS", 7, 14)


@pytest.mark.parametrize("step", [1, 7, 50])
def test_stream_equals_whole(step):
    text = "Please call. " + " ".join(t for t, _, _ in HIDDEN) + " and that is all there is to say about it. " * 4
    s, out = StableScrubber(tail=60), ""
    for i in range(0, len(text), step):
        piece = s.feed(text[i : i + step])
        out += piece
        assert not any(secret in out for _, _, secret in HIDDEN)
    assert out and out + s.flush() == R.scrub(text)


@pytest.mark.parametrize("step", [3, 40, 211])
def test_long_streams_equal_the_whole_and_keep_little(step):
    """Ten thousand characters with secrets all along: the same text, and a state that doesn't grow."""
    some = [t for t, _, _ in HIDDEN]
    text = " ".join(f"{some[i % len(some)]} and so on, line {i} of many words without any meaning;" + ("\n" if i % 3 == 0 else "") for i in range(120))
    s, out, most = StableScrubber(), "", 0
    for i in range(0, len(text), step):
        out += s.feed(text[i : i + step])
        most = max(most, len(s.raw))
    assert out + s.flush() == R.scrub(text) and len(text) > 8000 and most < 2000


def test_backoff(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 6, 80)], "n int").select(backoff(F.col("n"), 60.0)).collect()
    assert [r[0] for r in got] == [0.0, 60.0, 120.0, 900.0, 900.0, 900.0]


DIGITS = ("0123456789", "०१२३४५६७८९", "٠١٢٣٤٥٦٧٨٩", "０１２３４５６７８９", "".join(chr(0x11F50 + i) for i in range(10)))
ODD_CASE = {"s": "ſS", "k": "KK", "i": "İıI"}


@pytest.mark.parametrize("text", ["Account number: १२३४५६७८९०", "A/C no. ٠١٢٣٤٥٦٧٨٩", "ſreference no: ABCDEFG", "streetſ Green Lane"])
def test_columns_hide_what_the_function_hides(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(R.redact("t").alias("a"), F.size(R.detect("t")).alias("n")).first()
    assert got["a"] == R.scrub(text) and max(got["n"], 0) == len(R.find(text))


def test_no_text_with_a_finding_is_passed_by(spark):
    """Whatever is found, the hint is true: in every script's digits and every case that the patterns take."""
    r = random.Random(3)

    def odd(text):
        digits = r.choice(DIGITS)
        out = "".join(digits[int(c)] if c in DIGITS[0] and r.random() < 0.8 else c for c in text)
        out = "".join(r.choice(ODD_CASE[c.lower()]) if c.lower() in ODD_CASE and r.random() < 0.2 else c.swapcase() if r.random() < 0.1 else c for c in out)
        return r.choice(("", " ", "é", "ß ", "\n", "𞓳")) + out + r.choice(("", ".", "é", "क"))

    plain = [t for t, _, _ in HIDDEN] + ["borrower: Ram Kumar Gupta", "I am Kiran Sinha", "s/o Hari Singh", "14 Green streets near", "reference no: ABCD123", "policy number: LICABCDE", "file no ABCDEFG", "Dear Lisa Smith", "licence no: ABCDEF"]
    texts = [odd(r.choice(plain)) for _ in range(4000)] + plain
    found = [i for i, t in enumerate(texts) if R.find(t)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    passed = {row["i"] for row in df.where(~R.may_hold(F.col("t"))).collect()}
    assert len(found) > 1000 and not passed & set(found)
