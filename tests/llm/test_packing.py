import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from korpora.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_packs_every_piece(lengths):
    counts = np.bincount(lengths, minlength=41)[:41]
    plan = P.Planner(counts).plan()
    used = np.zeros(41, int)
    for seq, times in plan:
        assert sum(seq) <= 40
        for n in seq:
            used[n] += times
    assert (used == counts).all()


def test_exact_complements_are_found():
    counts = np.zeros(101, int)
    for n in (60, 26, 14, 90, 10, 70, 20, 7, 3):
        counts[n] += 5
    assert all(sum(s) == 100 for s, _ in P.Planner(counts).plan())


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbIs'1<|>,. \n\t\x01!" + "".join(map(chr, (0xE9, 0xDF, 0x130, 0xB5, 0x149, 0x131, 0x307, 0x308, 0x301))), max_size=60))
def test_words_give_the_texts_ids(text):
    e = P.WordEncoder(PATH)
    w = e.words(text.encode())
    e.learn(set(w))
    assert np.frombuffer(e.encode(w), "<u4").tolist() == e.ids(text)


def test_rows(spark, docs, odd, none):
    e = P.WordEncoder(PATH)
    for df, cap in ((docs, 2048), (odd, 100), (none, 10)):
        rows = P.packed(df, PATH, cap).collect()
        want = []
        for r in df.collect():
            ids = [*e.ids(r.text or ""), 0]
            want += [(r.doc_id, k, k * cap, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(-(-len(ids) // cap)) if (p := ids[k * cap : (k + 1) * cap])]
        assert sorted(str(tuple(r)[:5]) for r in rows) == sorted(map(str, want))
        by = defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for parts in by.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= cap
        total = sum(r.length for r in rows)
        assert len(by) <= max(-(-total // cap) * 1.02 + 1, 0)
