import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from korpora.llm import piece_codec as C

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(text):
    sp = C.checked(PATH)
    ids = sp.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def same(df, size=C.BATCH_BYTES):
    got = C.digests(C.encoded(df, PATH, size)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r.doc_id, *brute(r.text))) for r in df.collect())


def test_as_the_library(spark, docs, odd, none):
    for df in (docs, odd, none):
        same(df)


def test_small_batches(docs):
    same(docs, 20_000)


def test_strange_texts(spark):
    texts = [" ", "   ", "a", " a", "a ", "  a  b   c    ", "▁", "a▁b", "▁ ▁a", "\n", " \n ", "a\n\nb", "<s></s><unk>", "<0x0A>", "\u0000", " x y", "日本 語", "🙂 🙂x", "é", "�", "ﬁ①Ａ", "x" * 5000, " " * 3000, "ab " * 4000, None, ""]
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_long_texts_are_cut_alike():
    text = ("ab  c▁d\n e " * 120_000).encode()
    assert len(text) > C.LONG
    assert list(C.chunked(text)) == C.CHUNK.findall(b" " + text.replace("▁".encode(), b" "))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab\n\tthe"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=40))
def test_chunks_give_the_ids_of_the_text(text):
    sp = C.checked(PATH)
    parts = [c.decode() for c in C.chunked(text.encode())]
    pieces = C.segmented(sp, parts)
    assert [i for p in pieces for i in p] == sp.encode(text)
    assert " ".join(sp.decode(p) for p in pieces) == sp.decode(sp.encode(text))


def test_other_vocabularies_are_refused(monkeypatch):
    class Crossing:
        def __init__(self, model_file):
            pass

        def get_piece_size(self):
            return 2

        def is_unknown(self, i):
            return False

        def id_to_piece(self, i):
            return ["▁of", "of▁the"][i]

    import sentencepiece

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="cross"):
        C.checked("other.model")


def test_numbers_in_few_bytes():
    import numpy as np

    n = np.array([0, 1, 191, 192, 193, 447, 448, C.TWO - 1, C.TWO, C.TWO + 1, 2**31, 5], np.int64)
    assert C.long(*C.short(n)).tolist() == n.tolist()
    assert C.long(*C.short(n[:0])).tolist() == []
