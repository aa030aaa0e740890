import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from foliant.llm import op07_packing as op
from foliant.llm import textkernel as tk
from foliant.llm.wordtokens import WordTokens, place, unit_encoder, word_units

from .data import documents, odd_rows, prose

ODD = ["Straße <|endoftext|>x Σας it's 123", "CAFÉ ×÷ é ́a ﬁ", "a'LL 'd <x> |y| 7 77", "\x1c\x85 İı 漢字😀 ² ª", "##$$ -- a-b_c.d", ""]


def ids_of(text):
    t = Tokenizer.from_file(place("word_bpe_49k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


def test_units_equal_whole_texts():
    texts = ODD + [prose(1, 50).title() + ", " + ODD[0]]
    cache = WordTokens(unit_encoder("word_bpe_49k.json"))
    for at, t in tk.pieces(pa.array(texts)):
        low, units = word_units(t)
        ids, n = cache.tokens(low, units, low.hashes(units))
        doc = np.repeat(units.doc, n)
        for q in range(t.n):
            assert ids[doc == q].tolist() == ids_of(texts[at + q])


def test_every_id_in_one_piece(spark):
    rows = [r for r in odd_rows() if r[0] is not None] + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, prose(i, 300)) for i in range(60)]
    rows = list({r[0]: r for r in rows}.values())
    pieces = op.pack(documents(spark, rows, extra=True)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc_id, text, *_ in rows:
        ids, at = np.array([*ids_of(text), 2], "<u4"), 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0  # no padding at all


def test_hilbert_is_a_walk_over_the_grid():
    n = 8
    grid = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    key = op.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(n**3))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_copies_stand_together_and_reruns_agree(spark):
    rows = [(i, prose(i % 20, 40)) for i in range(100)]
    a, b = (sorted(map(tuple, op.pack(documents(spark, rows)).collect())) for _ in range(2))
    assert a == b
    (_, t), = tk.pieces(pa.array([r[1] for r in rows]))
    keys = op.curve_keys(t, op.Packing())
    assert all(keys[i] == keys[i % 20] for i in range(100)) and len(set(keys.tolist())) > 10


def test_empty(spark):
    assert op.pack(documents(spark, odd_rows()).where("false")).count() == 0
