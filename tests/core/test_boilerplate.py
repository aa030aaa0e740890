import pytest

from foliant.operators import quality as Q


@pytest.mark.parametrize("most", [200_000, 0])
def test_common_lines_go_by_broadcast_or_by_salted_join(spark, monkeypatch, most):
    """A header of every page goes, whatever its case and its place; amounts, rare lines and short lines stay."""
    monkeypatch.setattr(Q, "BROADCAST_LINES", most)
    rows = [("a", i, f"{'RUNNING' if i % 2 else 'running'} header of a\npage {i} says something\nTotal: 10.50\nok\nsecond header line") for i in range(40)]
    rows += [("b", i, f"Running header of a\nonly text {i}") for i in range(2)] + [("c", 1, None), ("c", 2, ""), ("c", 3, "one line of text")]
    got = {(r["group"], r["page"]): (r["text"], r["removed"]) for r in Q.without_boilerplate(spark.createDataFrame(rows, "g string, p int, t string"), "g", "p", "t").collect()}
    want = {(g, i): (f"page {i} says something\nTotal: 10.50\nok", 2) if g == "a" else (t, 0) for g, i, t in rows}
    assert got == want
