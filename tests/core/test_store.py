import pytest

from foliant.sources import store as S


def chunks(spark, rows):
    return spark.createDataFrame(rows, "document_id string, chunk_id string, content string")


def test_store(spark, tmp_path):
    st = S.ChunkStore(spark, str(tmp_path / "chunks"))
    st.add("a", chunks(spark, [("x.pdf", "1", "one"), ("x.pdf", "2", "two"), ("y/z:1.pdf", "1", "three")]))
    st.add("b@x.org", chunks(spark, [("x.pdf", "1", "other")]))
    st.replace("a", chunks(spark, [("x.pdf", "9", "new")]))
    assert {tuple(r) for r in st.documents("a").collect()} == {("x.pdf", 1), ("y/z:1.pdf", 1)}
    assert [r["content"] for r in st.read("b@x.org").collect()] == ["other"]
    assert st.delete("a", "y/z:1.pdf") and not st.delete("a", "y/z:1.pdf")
    assert [r["content"] for r in st.read("a").collect()] == ["new"]
    st.add("a", chunks(spark, [("w.pdf", "1", "more")]).selectExpr("*", "1 AS page"))
    assert {r["page"] for r in st.read("a").collect()} == {None, 1}
    assert st.delete("a") and st.read("a").count() == 0 and st.read("b@x.org").count() == 1


def test_tenants_do_not_collide():
    assert len({S.tenant_of(u) for u in ("a", "a@b", "a/b", "../a", "ü", "")}) == 6 and S.tenant_of("user_1-x") == "user_1-x"


def test_fold(spark):
    log = [(1, 1, "c", "create", "t"), (2, 2, "c", "message", "hi"), (3, 3, "c", "rename", "new"), (4, 4, "d", "create", "x"), (5, 5, "d", "delete", None), (6, 6, "c", "message", "yo"), (7, 7, "c", "attach", "a.pdf")]
    got = S.fold_conversations(spark.createDataFrame(log, "seq int, at int, conv_id string, kind string, value string")).collect()
    assert [tuple(r) for r in got] == [("c", "new", "a.pdf", None, 2, 7)]


def test_feedback(spark):
    df = lambda rows: spark.createDataFrame(rows, "message_id int, seq int, mark string")
    assert {tuple(r) for r in S.checked_feedback(df([(1, 1, "up"), (1, 2, None), (2, 1, "down")])).collect()} == {(1, None), (2, "down")}
    with pytest.raises(Exception, match="bad feedback"):
        S.checked_feedback(df([(1, 1, "sideways")])).collect()
