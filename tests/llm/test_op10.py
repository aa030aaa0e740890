import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import op10_mixture as op

from .data import documents, odd_rows, prose


def fair(sizes, weights, share=1.5, most=2):
    """Targets by resharing the excess again and again."""
    total, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            return out
        for i in over:
            out[i] = float(most * sizes[i])
        open_ -= over
    return out


def sources():
    return [(100 * s + i, prose(100 * s + i, 20 + 13 * s), "en", None if s == 6 else "sZaébB漢"[s]) for s in range(7) for i in range(4 + 3 * s)]


@pytest.mark.parametrize("m", [op.Mixture(), op.Mixture(block_words=16, shard_slots=8, bucket_words=64), op.Mixture(block_words=1, shard_slots=5)])
def test_targets_and_limits(spark, m):
    rows = sources() + odd_rows()[:8]
    got = op.mix_documents(documents(spark, rows, extra=True), m).toPandas()
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3] if len(r) > 3 else "s0", []).append(r)
    order = sorted((s for s in by_source if s is not None)) + [None] * (None in by_source)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = [sum(size(r[1]) for r in by_source[s]) for s in order]
    want = fair(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))])
    for s, n, t in zip(order, sizes, want, strict=True):
        ids = {r[0] for r in by_source[s]}
        part = got[got.doc_id.isin(ids) & (got.source_size == n)]
        assert abs(part.target - t).max() < 1e-6
        assert abs(part.taken.sum() - t) <= 1
    assert (got.taken <= 2 * got["size"]).all() and len(got) == len(rows)


def test_reruns_agree(spark):
    docs = documents(spark, sources())
    a = sorted(map(tuple, op.mix_documents(docs).collect()))
    assert a == sorted(map(tuple, op.mix_documents(docs.repartition(7)).collect()))


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 10, 97, 128):
        m = spark.range(n).select(op.permuted(F.col("id"), F.lit(n).cast("long"), (F.lit(3), F.lit(0)), op.Mixture()).alias("x"))
        assert sorted(r["x"] for r in m.collect()) == list(range(n))


def test_shard_counts_add_up_to_quotas(spark):
    m = op.Mixture(block_words=2, shard_slots=16)
    rows = spark.createDataFrame([(i, i, f"s{i % 3}", 50) for i in range(30)], "rid long, doc_id long, source string, size long")
    q = op.quotas(op.targets(rows, m), m)
    counts = op.shard_counts(spark, q, m)
    total = {r["rank"]: r["n"] for r in counts.groupBy("rank").agg(F.sum("count").alias("n")).collect()}
    assert total == {r["rank"]: r["slots"] for r in q.collect()}
    per_shard = counts.groupBy("shard").agg(F.sum("count").alias("n")).collect()
    assert max(r["n"] for r in per_shard if r["shard"] < 10) <= 16
    slots = op.mix_slots(spark, q, m).collect()
    assert len({(r["rank"], r["slot"]) for r in slots}) == len(slots) and all(0 < r["length"] <= 2 for r in slots)


def test_mixed_texts(spark):
    docs = documents(spark, sources() + [(7, "  spaced   text\n kept ", "en", "s"), (7, "  spaced   text\n kept ", "en", "s")], extra=True)
    m = op.Mixture(block_words=16)
    out = op.mixed_documents(docs, m)
    assert out.columns == docs.columns
    want = {r["doc_id"]: r["n"] for r in op.mix_documents(docs, m).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0").collect()}
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum(op.word_count(F.col("text"))).alias("n")).collect()}
    assert got == want and out.where(F.col("n_chars") != F.length("text")).count() == 0
    words = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    for r in out.collect():
        mine = iter(words[r["doc_id"]])
        assert all(any(w == x for x in mine) for w in r["text"].split())  # in order, from the document


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "", "en", "a")]])
def test_small_tables(spark, rows):
    docs = documents(spark, rows or odd_rows())
    docs = docs if rows else docs.where("false")
    got = op.mix_documents(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] == 0 for r in got)
    assert op.mixed_documents(docs).count() == 0


def hashed(*values, seed=42):
    """Spark's xxhash64 of strings and whole numbers: each one's hash is the seed of the next."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(8 if isinstance(v, Long) else 4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


class Long(int):
    """A number of eight bytes; plain ones have four."""


def shuffled(pos, n, key, m):
    for r in range(m.rounds):
        k = hashed(m.seed, "key", r, *key) % n
        other = (k - pos) % n
        if hashed(m.seed, "coin", r, *key, Long(max(pos, other))) & 1:
            pos = other
    return pos


def test_permutation_against_python(spark):
    m = op.Mixture()
    for n in (5, 64, 101):
        got = spark.range(n).select("id", op.permuted(F.col("id"), F.lit(n).cast("long"), (F.lit(3).cast("long"), F.lit(1).cast("long")), m).alias("x")).collect()
        assert all(r["x"] == shuffled(r["id"], n, (Long(3), Long(1)), m) for r in got)


@pytest.mark.parametrize("m", [op.Mixture(block_words=16, shard_slots=8, bucket_words=64, group_shards=3), op.Mixture(block_words=7, shard_slots=4, bucket_words=32, task_slots=2)])
def test_taken_words_against_python(spark, m):
    """Streams, slots and blocks laid out again from sizes, counts and the permutation: the same words of every document."""
    rows = [(i, i, "abc"[i % 3], (i * 7) % 40) for i in range(60)]
    sized = spark.createDataFrame(rows, "rid long, doc_id long, source string, size long")
    placed, ranges = op.mix(spark, sized, m)
    q = {r["rank"]: r for r in op.quotas(op.targets(sized, m), m).collect()}
    counts = op.shard_counts(spark, op.quotas(op.targets(sized, m), m), m).collect()
    streams = {}
    for r in placed.collect():
        streams.setdefault(r["rank"], []).append((r["offset"], r["size"], r["rid"]))
    want = Counter()
    for rank, docs in streams.items():
        at = 0
        for offset, size, _ in sorted(docs):  # end to end, without gaps
            assert offset == at
            at += size
        words = [rid for _, size, rid in sorted(docs) for _ in range(size)]
        source, b = q[rank], m.block_words
        slots = sorted((s, r["shard"]) for r in counts if r["rank"] == rank for s in range(r["first"], r["first"] + r["count"]))
        assert [s for s, _ in slots] == list(range(source["slots"]))
        left = source["words"]
        for slot in range(source["slots"]):
            turn, pos = divmod(slot, source["blocks"])
            short = source["blocks"] - 1
            block = shuffled(pos, short, (Long(rank), Long(turn)), m) if pos < short else short
            mine = words[block * b : (block + 1) * b][:left] if slot == source["slots"] - 1 and source["rest"] else words[block * b : (block + 1) * b]
            left -= len(mine)
            want.update(mine)
        assert left == 0
    got = Counter()
    for r in ranges.collect():
        got[r["rid"]] += r["upto"] - r["from"]
    assert got == want


def test_a_null_and_a_source_that_change_places(spark):
    """Rows that hash alike where nulls are skipped keep their own texts; very long texts and repeats are mixed too."""
    rows = [(7, "alpha beta", None, "s"), (7, "alpha beta", "s", None), (7, None, "alpha beta", "s")] + [(9, prose(5, 60_000), "en", "s")] + [(8, prose(1, 30), "en", "t")] * 4
    docs = documents(spark, rows)
    out = op.mixed_documents(docs, op.Mixture(block_words=64))
    got = Counter((r["doc_id"], r["lang"], r["source"]) for r in out.collect())
    assert set(got) <= {(r[0], r[2], r[3]) for r in rows if r[1]} and out.where("text is null").count() == 0
    sizes = op.mix_documents(docs, op.Mixture(block_words=64)).collect()
    assert len(sizes) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in sizes)
