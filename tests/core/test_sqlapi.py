from foliant.functions import sqlapi
from foliant.operators import bm25


def test_functions_in_sql(spark, tmp_path):
    spark.createDataFrame([(1, "mail a@b.org now ﬁne"), (2, None)], "id int, text string").write.parquet(f"{tmp_path}/notes.parquet")
    sqlapi.register(spark, str(tmp_path), ("notes",))
    got = spark.sql("SELECT id, pii_redact(text) AS t, size(pii_spans(text)) AS n, nfkc(text) AS k FROM notes ORDER BY id").collect()
    assert (got[0]["t"], got[0]["n"], got[0]["k"][-4:]) == ("mail <EMAIL_ADDRESS> now ﬁne", 1, "fine") and got[1]["t"] is None
    rows = spark.sql("SELECT id, n, chunk FROM notes, LATERAL chunk_text(text, 10, 2) ORDER BY id, n").collect()
    assert [r["n"] for r in rows] == list(range(1, len(rows) + 1)) and all(len(r["chunk"]) <= 10 for r in rows)


def test_streamed_index_equals_a_build(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"red {'apple' if i % 2 else 'pear'} number{i}") for i in range(8)], "doc_id long, text string")
    for part in (0, 1):
        docs.where(f"doc_id % 2 = {part}").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
        bm25.index_stream(stream, f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
    index = bm25.Index.load(spark, f"{tmp_path}/index")
    terms = bm25.query_terms(spark.createDataFrame([(0, "red apple number3")], "query_id long, text string"))
    score = lambda i: {(r["doc_id"], r["score"]) for r in bm25.score(i, terms).collect()}
    assert score(index) == score(bm25.build(docs))
