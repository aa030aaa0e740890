import re
from collections import Counter

import corpus_pipeline as pipeline
from foliant.llm import queries
from foliant.llm.op03_fertility import judge

from .data import documents, odd_rows, prose
from .test_op06 import edited, shingles


def corpus():
    rows = [(i, prose(i, 100), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100 + i, edited(prose(500, 200), 0.002 * i, i), "en", "s1") for i in range(6)]
    rows += [(200, prose(77, 60) + " token = 'abcdefgh12345' " + prose(78, 60), "en", "s2")]
    return rows + [(1000 + r[0], *r[1:]) for r in odd_rows() if r[0] is not None]


def test_stages_one_by_one(spark, tmp_path):
    docs = documents(spark, corpus())
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES:
        before, out = docs, stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns
        if name == "quality_rules":
            kept = {r["doc_id"] for r in judge(before).where("kept").collect()}
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i in kept) and not kept & {1004, 1005, 1006, 1007}
        if name == "near_dedup":
            texts = [shingles(r["text"], 5) for r in docs.collect()]
            assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(texts) for b in texts[:i])
            for r in before.collect():  # every text that went has a kept one of its group
                assert any(r["text"] == k["text"] for k in docs.collect()) or r["doc_id"] >= 100
        if name == "secret_scan":
            assert "<SECRET>" in docs.where("doc_id = 200").first()["text"] and docs.count() == before.count()
        if name == "mix_sources":
            words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect())
            assert abs(words(docs) - 1.5 * words(before)) <= 3
    assert seen == ["quality_rules", "near_dedup", "secret_scan", "mix_sources", "packing"] and docs.count() > 0


def test_run_is_registered_over_whole_tables(spark, tmp_path):
    documents(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))


def test_empty_table(spark, tmp_path):
    documents(spark, corpus()).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_in_every_stage(spark, tmp_path):
    """Null and repeated ids, equal rows, a null and a text that change places, very long texts, columns with the operators' own names."""
    twin = prose(321, 90)
    near = [(None, edited(prose(654, 150), 0.004 * i, i), "en", None) for i in range(4)]
    rows = corpus() + [(1000 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in odd_rows()] + [(7, twin, None, "s"), (7, None, twin, "s"), (7, twin, None, "s"), (None, twin + " tail", None, None)] + near
    docs = documents(spark, rows, extra=True)
    columns, before = docs.columns, None
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            break
        assert docs.columns == columns and docs.where("text is null").count() == 0
        if name == "quality_rules":
            want = Counter((r["doc_id"], r["text"], r["lang"]) for r in before.collect())
            got = Counter((r["doc_id"], r["text"], r["lang"]) for r in docs.collect())
            assert not got - want and got[(7, twin, None)] == 2 and (7, None, twin) not in got
        if name == "near_dedup":
            kept = [(r["doc_id"], r["text"]) for r in before.collect()]
            groups = brute_groups([t for _, t in kept], 80, 5)
            texts = [r["text"] for r in docs.collect()]
            assert len(texts) == len(groups) and all(sum(t in {kept[i][1] for i in g} for t in texts) == 1 for g in groups)
        if name == "secret_scan":
            assert docs.count() == before.count()
    assert docs.count() > 0


def brute_groups(texts, percent, k):
    """Classes of texts that are linked, by all pairs."""
    sets, left = [shingles(t, k) for t in texts], list(range(len(texts)))
    groups = []
    while left:
        group, edge = [left[0]], [left.pop(0)]
        while edge:
            i = edge.pop()
            linked = [j for j in left if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
            left = [j for j in left if j not in linked]
            group += linked
            edge += linked
        groups.append(group)
    return groups


def test_runs_do_not_take_each_other_s_tables(spark, tmp_path):
    """Two results that are read late, after both runs."""
    documents(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    one, two = pipeline.run(spark, str(tmp_path)), pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, one.select("doc_id", "start", "length", "ids_crc32").collect())) and one.count() == two.count()
