import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import public_tokenizers

from korpora.llm import lm_scoring as M
from korpora.llm.common import LOWER, remainder

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    split = [(i, [w for w in (t or "").encode().translate(M.words.__globals__["LOWER"]).split()]) for i, t in rows]
    c = Counter(w for i, ws in split if learn(i) for w in ws)
    ends = sum(learn(i) for i, _ in split)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    log = lambda x: math.log10((x + 0.5) / (n + 0.5 * (v + 1)))
    return {i: (len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), n, sum(log(c[w]) for w in ws) + log(ends)) for i, ws in split}


def test_base_columns(spark, docs, odd, none):
    for df in (docs, odd):
        want = brute([(r.doc_id, r.text) for r in df.collect()])
        got = M.scored(df, PATH, remainder(5) == 1).collect()
        assert len(got) == df.count()
        for r in got:
            n, known, total, base = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and -1e9 < r.score < 0
    assert M.scored(none, PATH, remainder(5) == 1).count() == 0


def test_score_is_the_sum_over_all_segmentations(spark, docs):
    """Brute force over pieces counted anew: every segmentation of every word by plain recursion over its ends."""
    sp = M.vocabulary(PATH)
    rows = [(r.doc_id, (r.text or "").encode().translate(LOWER).decode().split(" ")) for r in docs.collect()]
    rows = [(i, [w for x in ws for w in re.split("[\x09-\x0D]", x) if w]) for i, ws in rows]
    learn = [ws for i, ws in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    c = Counter({i: 0.1 for i in usable})
    for w, n in Counter(w for ws in learn for w in ws).items():
        for i in sp.encode(w):
            c[i] += n
    whole = sum(c[i] for i in usable) + len(learn) + 0.1
    p = {sp.id_to_piece(i): c[i] / whole for i in usable}
    assert math.isclose(sum(p.values()) + (len(learn) + 0.1) / whole, 1, rel_tol=1e-9)
    own = {x: v for x, v in p.items() if not re.fullmatch("<0x..>", x)}

    @lru_cache(None)
    def word(s):
        total = 1.0 if not s else 0.0
        for n in range(1, min(len(s), 40) + 1):
            if (v := own.get(s[:n])) is not None:
                total += v * word(s[n:])
        if s and s[0] not in own:
            total += math.prod(p[f"<0x{b:02X}>"] for b in s[0].encode()) * word(s[1:])
        return total

    got = {r.doc_id: r.score for r in M.scored(docs, PATH, remainder(5) == 1).collect()}
    some = sorted(rows)[::4]
    for i, ws in some:
        assert math.isclose(got[i], sum(math.log10(word("▁" + w)) for w in ws) + math.log10((len(learn) + 0.1) / whole), rel_tol=1e-6), i
    assert len(some) >= 50


def test_forward_recursion_sums_all_segmentations():
    pieces = {M.MARK: 0.1, M.MARK + "a": 0.2, "a": 0.15, "b": 0.1, "ab": 0.2, "ba": 0.05, "aba": 0.1}
    lattice = M.Lattice({k: math.log(v) for k, v in pieces.items()}, [math.log(1e-3)] * 256)

    def total(s):
        return 1.0 if not s else sum(p * total(s[len(k) :]) for k, p in pieces.items() if s.startswith(k))

    for w in ("a", "ab", "aba", "abab", "bbaba"):
        assert math.isclose(math.exp(lattice.word(w)), total(M.MARK + w), rel_tol=1e-12)
    assert math.isclose(lattice.word("é"), math.log(0.1) + 2 * math.log(1e-3))
