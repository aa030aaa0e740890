import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import op02_language as lang
from foliant.llm import op03_fertility as fert
from foliant.llm import textkernel as tk
from foliant.llm.wordtokens import WordTokens, encoder, listed

from .data import documents, odd_rows, prose

ENGLISH, GERMAN = "the of and to in is that with for this", "der die und das nicht ein für über straße ist"


def mixed(words, n, seed):
    r = np.random.RandomState(seed)
    return " ".join(r.choice(words.split(), n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, mixed(ENGLISH if i % 2 else GERMAN, 40, i), "en" if i % 2 else "de") for i in range(60)]
    return lang.fit(documents(spark, rows), F.lit(True), lang.Languages(per_language=50))


def test_languages_and_mixtures(spark, model):
    p = lang.Languages()
    rows = [(1, mixed(ENGLISH, 30, 7)), (2, mixed(GERMAN, 30, 8)), (3, mixed(ENGLISH, 60, 9) + " " + mixed(GERMAN, 20, 9)), (4, None), (5, "12 34 !! ½ ²"), (6, "")]
    got = lang.identify(documents(spark, rows, extra=True), model, p).toPandas().set_index("doc_id")
    assert list(got.lang_pred) == ["en", "de", "en", "und", "und", "und"]
    assert abs(got.loc[3].score - 0.75) < 0.05 and len(got.loc[3].languages) == 2 and len(got.loc[1].languages) == 1


def test_mixture_maximises_the_likelihood(model):
    """EM's proportions beat a fine grid, up to the steps taken."""
    (_, t), = tk.pieces(pa.array([mixed(ENGLISH, 50, 1) + " " + mixed(GERMAN, 30, 2)]))
    p = lang.Languages(steps=50)
    share, size = lang.mixtures(t, model, p)
    b, word, doc = lang.grams(t, p)
    like = np.zeros((len(doc), 2))
    np.add.at(like, word, model.logs[b])
    value = lambda s: np.logaddexp(math.log(s) + like[:, 0], math.log(1 - s) + like[:, 1]).sum()
    assert size[0] == 2 and value(share[0][0]) >= max(value(s) for s in np.linspace(0.01, 0.99, 99)) - 1e-3


def test_no_languages(spark):
    empty = lang.fit(documents(spark, odd_rows()), F.lit(False), lang.Languages())
    got = lang.identify(documents(spark, odd_rows()), empty, lang.Languages()).toPandas()
    assert set(got.lang_pred) == {"und"} and set(got.score) == {0.0}


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c, covered = Counter(zip(w, w[1:], w[2:])), set()  # noqa: B905
    for i, g in enumerate(zip(w, w[1:], w[2:])):  # noqa: B905
        if c[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_against_python(spark):
    rows = odd_rows() + [(20, "a b c\na b c\n x a b c d\n\n a b c \n"), (21, "a a a a a"), (22, "# $ é漢 <x>"), (23, "\n".join(["same line here"] * 30))]
    got = fert.judge(documents(spark, rows, extra=True), fert.Fertility()).toPandas()
    want = Counter((r[0], *counts(r[1])) for r in rows)
    assert Counter((None if x.doc_id != x.doc_id else int(x.doc_id), x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in got.itertuples()) == want
    assert all((x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) == x.base_failed and not (x.base_failed and x.kept) for x in got.itertuples())


def test_fertility_measures_and_bands(spark):
    rows = [(i, prose(i, 80)) for i in range(40)] + [(100, " ".join("漢字仮名" + chr(0x4E00 + i) for i in range(80)), None)]
    p = fert.Fertility()
    got = fert.judge(documents(spark, rows), p).toPandas().set_index("doc_id")
    words = prose(3, 80).split()
    pieces, plain = encoder(p.byte_fallback), encoder(p.byte_level, lead=" ")
    n = Counter(t for ids in pieces(words) for t in ids)
    entropy = -sum(c / n.total() * math.log2(c / n.total()) for c in n.values())
    assert abs(got.loc[3].entropy - entropy) < 1e-5
    assert abs(got.loc[3].chars_per_token - sum(map(len, words)) / sum(map(len, plain(words)))) < 1e-5
    assert got.loc[list(range(40))].kept.all() and got.loc[100].kept and got.loc[100].byte_share > 0.2 and got.loc[100].band == "script:kana_han"


def test_quartiles_are_exact(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 80.0]
    m = spark.createDataFrame([("g", 100, 0, v, 0.0, 1.0) for v in values], "band string, n_words long, n_repeat_words long, chars_per_token double, byte_share double, entropy double")
    f = {r["band"]: r for r in fert.fences(m, fert.Fertility()).collect()}
    assert f["g"]["documents"] == 8 and abs(f["g"]["low_0"] - (2.0 - 3 * 4.01)) < 1e-6 and abs(f["g"]["high_0"] - (6.01 + 3 * 4.01)) < 1e-6
    assert f["*"]["low_0"] == f["g"]["low_0"]


def test_word_cache_starts_afresh_and_keeps_nothing():
    words = encoder("piece_bpe_32k.model")
    with WordTokens(listed(words), most=2000) as cache:
        for _ in range(2):
            for _, t in tk.pieces(pa.array([prose(i, 20) for i in range(5)])):
                w = t.words()
                ids, n = cache.tokens(t, w, t.hashes(w))
                assert ids.tolist() == [x for q in range(t.n) for w_ in words(t.text(q).split()) for x in w_] and len(n) == len(w.starts)
    assert cache.encode is None and cache.n == 0 and cache.nbytes < 1 << 20


def test_empty_table(spark):
    none = documents(spark, odd_rows()).where("false")
    assert fert.judge(none).count() == 0


def test_small_groups_are_judged_by_themselves(spark):
    """Clean texts of a rare script stay beside a large group of another, and their own outlier goes."""
    kanji = lambda i: " ".join("漢字仮名" + chr(0x4E00 + (7 * i + j) % 90) for j in range(80))
    rows = [(i, prose(i, 80), "en") for i in range(220)] + [(1000 + i, kanji(i), None) for i in range(12)] + [(2000, " ".join("かなのは" + chr(0x3042 + j) for j in range(80)), None)]
    got = fert.judge(documents(spark, rows)).toPandas().set_index("doc_id")
    assert set(got.loc[1000:2000].band) == {"script:kana_han"} and (got.loc[1000:1011].byte_share > 0.2).all()
    assert got.loc[1000:1011].kept.all() and not got.loc[2000].kept


def test_every_language_is_learned_and_sets_grow_past_three(spark):
    r = np.random.RandomState(5)
    words = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(70 * 8)]
    own = lambda l: " ".join(words[8 * l : 8 * l + 8])
    rows = [(10 * l + i, mixed(own(l), 40, i), f"l{l:02}") for l in range(70) for i in range(3 if l < 69 else 2)]
    p = lang.Languages(per_language=50)
    model = lang.fit(documents(spark, rows), F.lit(True), p)
    assert len(model.names) == 70
    texts = [(1, mixed(own(69), 40, 99)), (2, " ".join(mixed(own(l), 60, l) for l in range(5)))]
    for q in (p, lang.Languages(per_language=50, cells=1)):  # in parts of any size
        got = lang.identify(documents(spark, texts), model, q).toPandas().set_index("doc_id")
        assert got.loc[1].lang_pred == "l69" and {x.split(":")[0] for x in got.loc[2].languages} == {f"l{l:02}" for l in range(5)}


def test_verdicts_do_not_jump_with_the_size_of_a_group(spark):
    """The same outlier and the same clean texts in groups of 199 and of 200."""
    for n in (5, 199, 200):
        rows = [(i, prose(i, 80), "en") for i in range(300)] + [(1000 + i, prose(2000 + i, 80), "xx") for i in range(n)] + [(5000, " ".join("漢字" + chr(0x4E00 + j) for j in range(80)), "xx")]
        got = fert.judge(documents(spark, rows)).toPandas().set_index("doc_id")
        assert got.loc[1000 : 999 + n].kept.all() and not got.loc[5000].kept


def test_scripts():
    texts = ["สวัสดีครับ ภาษา", "ສະບາຍດີ", "გამარჯობა", "ሰላም ለዓለም", "សួស្តី", "नमस्ते", "𠀀𠀁", "привет hi", "123 !?", "Ünï", "𐌰𐌱"]
    (_, t), = tk.pieces(pa.array(texts))
    assert fert.scripts_of(t).tolist() == ["thai", "lao", "georgian", "ethiopic", "khmer", "devanagari", "kana_han", "cyrillic", "und", "latin", "beyond"]
    code, at = fert.code_points(t)
    assert code.tolist() == [ord(c) for x in texts for c in x]


def test_rows_meet_their_own_verdicts(spark):
    """A null and a text that change places are two rows; only the one with the text stays."""
    text = prose(3, 90)
    rows = [(7, text, None), (7, None, text), (7, text, None), (None, text, "en"), (8, "", "")]
    docs = documents(spark, rows, extra=True)
    kept = fert.accepted(docs)
    assert kept.columns == docs.columns and [(r["doc_id"], r["text"]) for r in kept.orderBy("doc_id").collect()] == [(None, text), (7, text), (7, text)]


def test_language_set_is_the_best_of_all_sets(spark):
    """Every subset of five languages by its own maximum likelihood: the chosen one has the highest penalised value, or as good as."""
    r = np.random.RandomState(5)
    words = ["".join(r.choice(list("abcdefgh"), 4)) for _ in range(5 * 10)]
    own = lambda l: " ".join(words[10 * l : 10 * l + 10])
    p = lang.Languages(per_language=50, steps=60)
    model = lang.fit(documents(spark, [(10 * l + i, mixed(own(l), 40, i), f"l{l}") for l in range(5) for i in range(4)]), F.lit(True), p)
    for text in (mixed(own(0), 40, 1), mixed(own(1), 30, 2) + " " + mixed(own(3), 20, 3), " ".join(mixed(own(l), 15, l) for l in (0, 2, 4)), mixed(own(2), 3, 4)):
        (_, t), = tk.pieces(pa.array([text]))
        share, size = lang.mixtures(t, model, p)
        b, word, doc = lang.grams(t, p)
        like = np.zeros((len(doc), 5))
        np.add.at(like, word, model.logs[b].astype(np.float64))
        like -= like.max(1, keepdims=True)

        def value(chosen, like=like):
            ratio = np.exp(np.maximum(like[:, chosen], -30.0))
            pi = np.full(len(chosen), 1 / len(chosen))
            for _ in range(500):
                r = ratio * pi
                pi = (r / np.maximum(r.sum(1, keepdims=True), 1e-300)).mean(0)
            return np.log(np.maximum((ratio * pi).sum(1), 1e-300)).sum() - (len(chosen) - 1) * p.penalty * math.log(len(like) + 1)

        sets = [[l for l in range(5) if m >> l & 1] for m in range(1, 32)]
        mine = sorted(np.flatnonzero(share[0]).tolist())
        assert size[0] == len(mine) and value(mine) >= max(map(value, sets)) - 0.05


def test_language_sample_is_bounded_for_any_ids(spark):
    """One id with most of a language's rows, and copies of one row, teach no more than their bound."""
    rows = [(0, f"alpha beta {i}", "xx") for i in range(400)] + [(1, "gamma delta", "yy")] * 300 + [(2 + i, f"omega {i}", "yy") for i in range(5)]
    p = lang.Languages(per_language=20)
    assert lang.sampled(documents(spark, rows), p).groupBy("lang").count().orderBy("lang").collect() == [("xx", 20), ("yy", 6)]
    model = lang.fit(documents(spark, rows), F.lit(True), p)
    assert model.names == ["xx", "yy"]
    got = lang.identify(documents(spark, [(1, "alpha beta 7"), (2, "omega 3")]), model, p).toPandas().set_index("doc_id")
    assert list(got.lang_pred) == ["xx", "yy"]
