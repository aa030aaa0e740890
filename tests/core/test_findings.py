"""What a review of odd inputs and larger tables found."""

import itertools

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.operators import bm25
from foliant.operators import dialogue as D
from foliant.operators import quality as Q
from foliant.operators import redact as P
from foliant.sources import web
from foliant.streaming import state as S


def test_deltas_that_come_together_are_scanned_once(monkeypatch):
    """The stream's text is that of the whole, and deltas of one batch don't cost a scan each."""
    import pandas as pd

    text = "Write to a.b@x.org or call. " * 40
    cut = [text[i : i + 24] for i in range(0, len(text), 24)]
    scans, plain = [], P.find
    monkeypatch.setattr(S, "find", lambda t: scans.append(1) or plain(t))
    monkeypatch.setattr(S, "scrub", lambda t: scans.append(1) or P.scrub(t))
    held = {}

    class Tokens:
        def groupBy(self, key):
            return self

        def applyInPandasWithState(self, run, *a):
            held["run"] = run
            return self

    class State:
        exists, get, left = False, None, None

        def update(self, x):
            State.exists, State.get = True, x

        def remove(self):
            State.left = "nothing"

    S.scrub_stream(Tokens())
    frame = lambda at, part, last: pd.DataFrame({"answer_id": 1, "seq": range(at, at + len(part)), "delta": part, "is_last": [False] * (len(part) - 1) + [last]})
    half = len(cut) // 2
    out = [x for at, part, last in ((0, cut[:half], False), (half, cut[half:], True)) for f in held["run"]((1,), iter([frame(at, part, last)]), State()) for x in f.itertuples(index=False)]
    assert "".join(x.text for x in out) == P.scrub(text) and [x.seq for x in out] == [half - 1, len(cut) - 1]
    assert State.left == "nothing" and len(scans) < 10


def test_an_intent_names_each_pattern_once(spark):
    """The plan of an order of providers doesn't grow with how often the intent is used."""
    df = spark.createDataFrame([("Why does it meet the limit?",), ("hello",), (None,), ("flag the summary",)], "q string")
    one = F.array(F.lit("nvidia"), F.lit("groq"))
    got = df.select("q", D.intent(F.col("q")).alias("i"), F.array_join(D.provider_order(D.intent(F.col("q")), one, F.array(F.lit("groq"))), ",").alias("p"))
    assert [r["i"] for r in got.collect()] == ["analysis", "general", None, "analysis"]
    assert [r["p"] for r in got.collect()][:2] == ["nvidia,groq", "nvidia,groq"]
    n = sum(map(len, D.INTENTS.values()))
    asked = spark.range(3).select(F.col("id").cast("string").alias("q"))
    assert asked.select(D.intent(F.col("q")).alias("i"))._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == n


@pytest.mark.parametrize("text", ["a highlight of it", "two highlights", "tldr", "tl;dr please", "key terms", "what is this file", "does it meet it", "xcompare", "IMPACT", "the impacts"])
def test_stems_leave_out_no_pattern(spark, text):
    low = F.lit(text.lower())
    pairs: list[Column] = [x for ps in D.INTENTS.values() for p in ps for x in (D._shows(low, p), low.rlike(p))]
    row = spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(pairs))).first()
    assert row[0::2] == row[1::2]


def test_names_shared_by_many_give_each_pair_once(spark):
    """Against all pairs, with entries of several names and rows that stand twice; no aggregate over the pairs of single names."""
    old = [(f"d{i}", f"f{i % 3}") for i in range(30)] + [("d1", "f2"), ("d1", "f0"), ("d2", "f2")]
    new = [(f"d{i}" if i % 2 else f"n{i}", f"f{i % 3}") for i in range(0, 30, 3)] + [("n0", "f0"), ("n0", "f1"), ("zz", None), ("d5", None)]
    df = lambda rows: spark.createDataFrame(rows, "document_id string, filename string")
    got = sorted(map(tuple, Q.replaced_by(df([*old, ("dz", None)]), df(new)).collect()))
    assert got == sorted({(a, b) for (a, f), (b, g) in itertools.product(old, new) if f == g or a == b})


@pytest.mark.parametrize(("html", "text"), [
    ("<p>a &amp;&amp;amp</p>", "a &&amp"), ("<p>R&amp</p>", "R&amp"), ("<p>&notit; &copy 1 &copy; &#65; &#66</p>", "&notit; &copy 1 © A &#66"), ("<p>a & b &lt;c&gt;</p>", "a & b <c>"),
])
def test_references_that_are_cut_off_stay(html, text):
    assert web.visible_text(html) == text


@pytest.mark.parametrize(("pairs", "batch"), [(1, 3), (7, 10_000), (1_000_000, 5)])
def test_a_search_never_holds_all_pairs(spark, monkeypatch, pairs, batch):
    """The best of each query, ties by id, as from the scores of all pairs; batches cut documents anywhere."""
    words = "red green blue one two three"
    docs = spark.createDataFrame([(i, " ".join(w for j, w in enumerate(words.split()) if (i * 7 + j) % 4 < 2) + " red" * (i % 3)) for i in range(60)] + [(97, None), (98, ""), (99, "...")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red one one"), (2, "blue"), (3, "nothing"), (4, ""), (5, words)], "query_id long, text string")
    scope = docs.where("doc_id % 2 = 0").select("doc_id")
    every = bm25.score(bm25.build(docs), bm25.query_terms(asked))
    want = [sorted(map(tuple, bm25.top_k(x, 4).collect())) for x in (every, every.join(scope, "doc_id", "left_semi").select("query_id", "doc_id", "score"))]
    monkeypatch.setattr(bm25, "PAIRS", pairs)
    monkeypatch.setattr(bm25, "score", lambda *a: pytest.fail("all pairs were made"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
        got = [rows(bm25.search(docs, asked, 4)), rows(bm25.search(docs, asked, 4, scope))]
        empty = bm25.search(docs, asked.limit(0)).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [[(r[0], r[1]) for r in g] for g in got] == [[(r[0], r[1]) for r in w] for w in want] and not empty
    assert all(abs(a[2] - b[2]) < 1e-9 and a[3] == b[3] for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))


def test_tokens_are_counted_in_their_rows(spark):
    docs = spark.createDataFrame([(1, "b a b c a b"), (2, None), (3, ""), (4, "x")], "doc_id long, text string")
    built = bm25.build(docs).postings
    assert sorted(map(tuple, built.select("doc_id", "term", "tf", "length").collect())) == [(1, "a", 2, 6), (1, "b", 3, 6), (1, "c", 1, 6), (4, "x", 1, 1)]
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()


def test_chunks_go_to_python_in_bounded_batches(spark, monkeypatch, tmp_path):
    """No batch has more than a thousand texts, however many a partition holds; a session's own setting stays."""
    from foliant.operators import chunk as C

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        pages = spark.range(3000).select(F.lit("s").alias("source"), F.col("id").alias("page"), F.lit("some words").alias("text")).coalesce(1)
        out = C.chunk_table(pages, "source", "page", "text")
        assert spark.conf.get(key) == "1000" and out.count() == 3000
        spark.conf.set(key, "77")
        C.chunk_table(pages, "source", "page", "text")
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, old)


def test_a_block_search_makes_no_pairs(spark, tmp_path, monkeypatch):
    """Blocks go to the ranges' tasks once; the best of each query, deleted documents and others than the scope's left out, however little is held at a time."""
    from foliant.operators import segments as S

    monkeypatch.setattr(S, "RANGE", 4)
    monkeypatch.setattr(S, "SEEDS", 2)
    words = "red green blue one two three".split()
    rows = [(i, " ".join(w for j, w in enumerate(words) if (i * 7 + j) % 4 < 2) + " red" * (i % 3)) for i in range(60)] + [(97, None), (98, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red one one"), (2, "blue"), (3, "nothing"), (4, " ".join(words))], "query_id long, text string")
    index = S.SegmentedIndex(spark, str(tmp_path / "i"))
    index.add(docs)
    index.delete(docs.where("doc_id % 5 = 0"))
    left, scope = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 2 = 0").select("doc_id")
    got = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())
    want = got(bm25.search(left, asked, 4)), got(bm25.search(left, asked, 4, scope))
    for pairs, sent in ((1, 5), (1_000_000, 500_000)):
        monkeypatch.setattr(bm25, "PAIRS", pairs)
        monkeypatch.setattr(S, "MOST_SENT", sent)
        assert (got(index.search(asked, 4)), got(index.search(asked, 4, scope))) == want
    plan = index.search(asked, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan


def test_blocks_are_made_of_ranges_in_pieces():
    """Documents of ranges, cut into batches anywhere: each range's postings by term."""
    import pyarrow as pa

    from foliant.operators import segments as S

    docs = [(9, 2, 0, ["a", "b"], [1, 1]), (3, 3, 0, ["a"], [3]), (5, 0, 1, [], []), (7, 4, 1, ["a", "c"], [2, 2]), (8, 1, 5, ["c"], [1])]
    schema = pa.schema([("doc_id", pa.int64()), ("length", pa.int32()), ("range", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))])
    table = pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*docs, strict=True), schema, strict=True)], schema=schema)
    want = [("a", 0, 2, [3, 9], [3, 1], [3, 2]), ("a", 1, 1, [7], [2], [4]), ("b", 0, 1, [9], [1], [2]), ("c", 1, 1, [7], [2], [4]), ("c", 5, 1, [8], [1], [1])]
    for size in (1, 2, 3, 5):
        assert sorted(tuple(r.values()) for b in S._blocks_of(iter(table.to_batches(size))) for r in b.to_pylist()) == want


def test_a_file_with_most_pages_is_spread(spark, monkeypatch):
    """Items and pages of one key meet in blocks, each pair once, in more than one task; keys of one side only give nothing."""
    from foliant.sources import golden

    monkeypatch.setattr(golden, "BLOCK", 7)
    items = spark.createDataFrame([(f"q{i}", "f" if i % 9 else "g", 2) for i in range(60)] + [("q1", "f", 2), ("x", "nowhere", 2), ("y", None, 2)], "id string, source_file string, page_number int")
    pages = spark.createDataFrame([("f" if i % 9 else "g", 2, i) for i in range(50)] + [("f", 3, 99), (None, 2, 98)], "source_file string, page_number int, doc_id long")
    keys = ["source_file", "page_number"]
    found = golden.opened(items, pages, keys)
    rows = lambda df: sorted(map(tuple, df.select("id", "page_number", "doc_id").collect()))
    assert rows(found) == rows(items.join(pages, keys))
    assert found.where("source_file = 'f'").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_a_task_writes_one_part_of_a_folder(spark, tmp_path, monkeypatch):
    """An index in many parts: each task sorts one part of one folder, never several that fell together."""
    import glob
    import re

    monkeypatch.setattr(bm25, "FILE_TOKENS", 20)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.expr("transform(sequence(1, 20), i -> concat('w', (id * i) % 300))")).alias("text"))
    bm25.build(docs).save(str(tmp_path / "i"))
    tasks = [re.search(r"part-(\d+)", f)[1] for f in glob.glob(f"{tmp_path}/i/postings/bucket=*/*.parquet")]
    assert len(tasks) > bm25.BUCKETS and len(set(tasks)) == len(tasks)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "term", "tf", "length").collect()))
    assert rows(bm25.Index.load(spark, str(tmp_path / "i")).postings) == rows(bm25.build(docs).postings)


def test_tasks_of_a_search_grow_in_number(spark, monkeypatch):
    """A task sorts a bounded number of postings, however few partitions the session has; the ranking stays."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("red "), F.expr("concat('w', id % 7)")).alias("text"))
    asked = spark.createDataFrame([(1, "red w1"), (2, "w2 w2"), (3, "none")], "query_id long, text string")
    got = lambda: sorted(map(tuple, bm25.search(docs, asked, 4).select("query_id", "rank", "doc_id", "score").collect()))
    want = got()
    monkeypatch.setattr(bm25, "TASK_POSTINGS", 30)
    index, terms = bm25.build(docs), bm25.query_terms(asked)
    assert bm25._best(index, terms, 4, None).rdd.getNumPartitions() == 13 and got() == want  # 300 of red, 43 of w1 and w2 each
    assert len(want) == 8


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_an_index_is_saved_with_one_pass_over_the_tokens(spark, tmp_path, batch):
    """Totals come of the saved postings, the texts aren't tokenised for them; no posting is lost, whatever the batches."""
    import dataclasses
    from collections import Counter

    docs = spark.createDataFrame([(f"d{i}", " ".join(f"w{i * j % 23}" for j in range(i % 11))) for i in range(50)] + [("n", None), ("e", ""), ("p", "...")], "doc_id string, text string")
    words = {r["doc_id"]: (r["text"] or "").replace("...", "").split() for r in docs.collect()}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        dataclasses.replace(bm25.build(docs), totals=None).save(str(tmp_path / "i"))
    finally:
        spark.conf.set(key, old)
    index = bm25.Index.load(spark, str(tmp_path / "i"))
    want = {(d, w, n, len(ws)) for d, ws in words.items() for w, n in Counter(ws).items()}
    got = [tuple(r) for r in index.postings.select("doc_id", "term", "tf", "length").collect()]
    assert set(got) == want and len(got) == len(want)
    assert [tuple(r) for r in index.totals.select("documents", "tokens").collect()] == [(53, sum(map(len, words.values())))]
    assert {r["term"]: r["df"] for r in index.frequencies.collect()} == Counter(w for ws in words.values() for w in set(ws))


def test_postings_are_shuffled_as_lists(spark):
    """A term of many documents of a batch is a row, not one for each document."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("red blue w"), F.col("id") % 3).alias("text")).coalesce(1)
    built = bm25.build(docs)
    assert built.blocks.count() <= 5 * (2000 // 250) and built.postings.count() == 6000


def test_a_task_writes_one_folder_of_frequencies_and_sorted_postings(spark, tmp_path):
    """No task counts several folders that fell together; a file's postings stand by term."""
    import glob
    import re

    import pyarrow.parquet as pq

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 20), i -> concat('w', (id * i) % 700)))").alias("text"))
    old = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    bm25.build(docs).save(str(tmp_path / "i"))
    tasks = [re.search(r"part-(\d+)", f)[1] for f in glob.glob(f"{tmp_path}/i/frequencies/bucket=*/*.parquet")]
    assert len(tasks) == len(set(tasks)) == bm25.BUCKETS
    for f in glob.glob(f"{tmp_path}/i/postings/bucket=*/*.parquet"):
        terms = pq.ParquetFile(f).read(["term"])["term"].to_pylist()
        assert terms == sorted(terms)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == old


def test_a_task_never_holds_all_rows_that_it_deals(spark, tmp_path, monkeypatch):
    """However large the table, rows are dealt to no more parts than Spark's shuffle appends to without sorting them in memory (200)."""
    import glob
    import re

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 20), i -> concat('w', (id * i) % 300)))").alias("text"))
    asked = spark.createDataFrame([(1, "w0 w1 w2"), (2, "w7")], "query_id long, text string")
    want = sorted(map(tuple, bm25.search(docs, asked, 4).collect()))
    monkeypatch.setattr(bm25, "FILE_TOKENS", 1)
    monkeypatch.setattr(bm25, "TASK_POSTINGS", 1)
    bm25.build(docs).save(str(tmp_path / "i"))
    index = bm25.Index.load(spark, str(tmp_path / "i"))
    assert max(int(re.search(r"part-(\d+)", f)[1]) for f in glob.glob(f"{tmp_path}/i/postings/bucket=*/*.parquet")) < 200
    assert bm25._best(index, bm25.query_terms(asked), 4, None).rdd.getNumPartitions() <= 200
    assert sorted(map(tuple, bm25.search(index, asked, 4).collect())) == want


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of documents too large to broadcast here, and items of which each text holds one."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old, path = spark.conf.get(key), tmp_path_factory.mktemp("corpus")
    text = "concat_ws(' ', concat('alpha', id % 9), concat('beta', id % 9), concat('gamma', id % 9), {})"
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr(text.format("sha2(string(id), 512), sha2(string(-id), 512)")).alias("text"), F.lit("en").alias("lang"), F.expr("concat('src', id % 4)").alias("source"))
    docs.withColumn("n_chars", F.length("text")).write.parquet(f"{path}/documents.parquet")
    spark.range(5).select(F.col("id").alias("item_id"), F.expr(text.format("'end'")).alias("text")).coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    spark.conf.set(key, "30k")
    yield str(path)
    spark.conf.set(key, old)


@pytest.mark.parametrize("query", ["citation_support", "citations", "context_blocks", "context_budget", "context_recall", "prompt_assembly"])
def test_texts_of_the_ranked_are_not_shuffled(spark, corpus, query):
    """The ranked rows go to the documents; the texts are read and not sorted."""
    from foliant.plans import registry

    plan = registry.QUERIES[query](spark, corpus)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(doc_id" not in plan


@pytest.mark.parametrize("query", ["multi_query_fuse", "ndcg_at_k", "mrr_at_k", "precision_at_k"])
def test_lists_that_are_read_again_are_made_once(spark, corpus, query):
    """What is read for each variant, or for hits and totals, isn't searched for again each time."""
    from foliant.plans import registry

    found = registry.QUERIES[query](spark, corpus)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "text" not in plan and found.count()


def test_cleaning_stats_of_empty_and_missing_texts(spark, tmp_path):
    """An empty text divides by nothing; the rows are the SQL's."""
    import duckdb

    from foliant.plans import text

    texts = ["", None, " ", "\n", "\u00ad", "a  b", "so-\nme \r\n\r\n lines\t\there"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(str, map(tuple, text.cleaning_stats(spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, con.sql(text.SQL["cleaning_stats"]).fetchall()))
    assert got[0] == "(0, 0, 0, nan)" and got[1] == "(1, None, None, None)"


def test_a_name_that_most_share_is_spread(spark, monkeypatch):
    """Entries of one name meet in blocks, each pair once, in more than one task; no task holds all rows of the name."""
    from foliant.sources import pairs

    for name, n in (("BLOCK", 7), ("PAIRS", 49)):
        monkeypatch.setattr(pairs, name, n)
    old = [(f"d{i}", "f" if i % 9 else "g") for i in range(60)] + [("d1", "g"), ("dz", None), ("dy", "alone")]
    new = [(f"d{i}" if i % 2 else f"n{i}", "f" if i % 9 else "g") for i in range(50)] + [("n2", "f"), ("zz", None), ("zy", "nowhere"), (None, "g")]
    df = lambda rows: spark.createDataFrame(rows, "document_id string, filename string")
    found = Q.replaced_by(df(old), df(new))
    shared = {(a, b) for (a, f), (b, g) in itertools.product(old, new) if b is not None and (a == b or f == g is not None)}
    assert sorted(map(tuple, found.collect())) == sorted(shared)
    assert found.where("document_id <> by").select(F.spark_partition_id().alias("p")).distinct().count() > 9
    both = pairs.paired(df(old).select("filename", "document_id"), df(new).distinct().withColumnRenamed("document_id", "by"), ["filename"])
    tasks = both.groupBy(F.spark_partition_id().alias("p"), "filename").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in tasks) == sum(f == g for (_, f), (_, g) in itertools.product(old, set(new)) if f is not None)
    assert len([r for r in tasks if r["filename"] == "f"]) > 3


def test_pairs_of_items_and_pages_are_not_sorted(spark, monkeypatch):
    """A pair costs a step through a list: what is sorted and shuffled are rows and lists; equal items and pages stay, nulls too."""
    from foliant.sources import golden, pairs

    monkeypatch.setattr(golden, "BLOCK", 6)
    monkeypatch.setattr(pairs, "PAIRS", 36)
    items = spark.createDataFrame([("a", "f")] * 40 + [(None, "f"), ("b", None), ("c", "g")], "id string, source_file string")
    pages = spark.createDataFrame([("f", i % 5) for i in range(30)] + [("f", None), (None, 1), ("h", 2)], "source_file string, doc_id long")
    found = golden.opened(items, pages, ["source_file"])
    rows = lambda df: sorted(map(str, map(tuple, df.select("id", "source_file", "doc_id").collect())))
    assert found.columns == ["id", "source_file", "doc_id"] and rows(found) == rows(items.join(pages, "source_file"))
    assert found.groupBy(F.spark_partition_id()).count().count() > 4
    assert "Generate inline" in found._jdf.queryExecution().optimizedPlan().toString()
