import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from korpora.llm.token_counts import count_tokens, spliced, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def offsets(s):
    return tokenizer(PATH).encode(s, add_special_tokens=False).offsets


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab '.s\n\t 1<|>" + "".join(map(chr, (0xA0, 0xE9, 0x2003, 0x3000))), min_size=0, max_size=400), st.integers(8, 40), st.integers(1, 12))
def test_splicing_is_exact(text, chunk, overlap):
    assert spliced(offsets, text, chunk, overlap) == len(offsets(text))


def test_rows(spark, docs, odd, none):
    t = tokenizer(PATH)
    for df in (docs, odd, none):
        got = sorted(count_tokens(df, PATH, whole=500, chunk=300, overlap=16).collect(), key=str)
        want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in df.collect()), key=lambda x: str(x))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
