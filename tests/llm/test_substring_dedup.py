import hashlib
import random

import numpy as np

from korpora.llm import substring_dedup as S


def brute(rows, k):
    """rows: (doc_id, text)."""
    first = {}
    split = [(S.LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            first[g] = min(first.get(g, (i, s)), (i, s))
    out = []
    for (i, w), (doc, _) in zip(split, rows, strict=True):
        gone = {s + j for s in range(len(w) - k + 1) if first[tuple(w[s : s + k])] < (i, s) for j in range(k)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(map(str, out))


def got(df, k, m):
    return sorted(str(tuple(r)) for r in S.deduplicated(df, k, m).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_documents(docs, odd, none):
    for df in (docs, odd, none):
        assert got(df, 20, 3) == brute([(r.doc_id, r.text) for r in df.collect()], 20)


def test_small_alphabets(spark):
    r = random.Random(3)
    rows = [(r.randrange(60), " ".join(r.choice("abc") for _ in range(r.randrange(40)))) for _ in range(120)] + [(100, "a " * 900), (101, "a b " * 700), (102, "a " * 21)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, 6, 2) == brute(rows, 6)


def test_least():
    x = np.random.default_rng(1).integers(0, 99, 50)
    for k in range(1, 50):
        assert (S.least(x, k) == [x[i : i + k].min() for i in range(50 - k + 1)]).all()


def test_buckets_in_parts(spark, docs, odd, monkeypatch):
    """Every packed string a part of its own: windows go on as fingerprints, and the result is the same."""
    monkeypatch.setattr(S, "HELD", 1)
    r = random.Random(5)
    rows = [(r.choice([None, *range(40)]), " ".join(r.choice("abc") for _ in range(r.randrange(40)))) for _ in range(150)] + [(100, "a " * 900), (101, "a b " * 700)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 6, 2) == brute(rows, 6)
    for df in (docs.repartition(7), odd):
        assert got(df, 20, 3) == brute([(r.doc_id, r.text) for r in df.collect()], 20)


def test_buckets_some_minimisers_at_a_time(spark, docs, odd, monkeypatch):
    """A minimiser at a time and a super-k-mer at a time cut into words: the result is the same."""
    monkeypatch.setattr(S, "SORTED", 1)
    monkeypatch.setattr(S, "CUT", 1)
    for df in (docs, odd):
        assert got(df, 20, 3) == brute([(r.doc_id, r.text) for r in df.collect()], 20)


def test_slices():
    lengths, keys = np.array([3, 3, 9, 1, 1, 1]), np.array([1, 1, 2, 2, 2, 5])
    assert [(x.start, x.stop) for x in S.slices(lengths, 4)] == [(0, 1), (1, 2), (2, 3), (3, 6)]
    assert [(x.start, x.stop) for x in S.slices(lengths, 4, keys)] == [(0, 2), (2, 5), (5, 6)]
    assert not list(S.slices(lengths[:0], 4))
