import random
import re

import numpy as np
import pytest

from korpora.llm import jaccard_join as J
from korpora.llm.components import components


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        near = {}
        for g in s:
            for j in holders.setdefault(g, []):
                near[j] = near.get(j, 0) + 1
            holders[g].append(i)
        for j, n in near.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(str((d, len(sets[i]), low.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def got(df, k, percent):
    return sorted(str(tuple(r)) for r in J.classes(df, k, percent).drop("own", "first").collect())


def test_documents(docs, odd, none):
    for df in (docs, odd, none):
        assert got(df, 4, 85) == brute([(r.doc_id, r.text) for r in df.collect()], 4, 85)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 60)])
def test_families_of_near_copies(spark, k, percent, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 7)
    r = random.Random(percent)
    rows = []
    for f in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice((3, 8, 14, 30, 60, 150, 400)))]
        for _ in range(r.choice((1, 3, 40))):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 12)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, percent) == brute(rows, k, percent)


def test_pigeonhole_misses_no_pair():
    r = np.random.default_rng(7)
    for percent in (60, 80, 85, 95):
        scheme = J.Scheme(percent, 4000)
        for n in [*range(1, 60), 99, 250, 700, 1500]:
            base = r.integers(0, 2**63, n).astype(np.uint64)
            other = [base]
            for _ in range(12):
                gone, new = r.integers(0, n // 5 + 2), r.integers(0, n // 5 + 2)
                other.append(np.unique(np.concatenate([base[: max(0, n - gone)], r.integers(0, 2**63, new).astype(np.uint64)])))
            other = [np.unique(x) for x in other if len(x)]
            sizes = np.array([len(x) for x in other])
            sig, holder, probing, least = J.signatures(np.concatenate(other), np.repeat(np.arange(len(other)), sizes), sizes, scheme)
            link = J.linked(other, other, percent)
            by = [set(sig[holder == i].tolist()) for i in range(len(other))]
            probes = [set(sig[(holder == i) & probing].tolist()) for i in range(len(other))]
            for i, j in zip(*np.nonzero(link), strict=True):
                if i < j and not np.array_equal(other[i], other[j]):
                    assert probes[i] & by[j] or probes[j] & by[i], (percent, n, sizes[i], sizes[j])
                    common = np.isin(sig, list(by[i] & by[j]))
                    for x in (i, j):
                        assert any((common & (holder == x) & (least == k)).sum() >= k for k in set(least[holder == x].tolist()))


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 50), (60, 100), (60, 70), (7, 7)]
    out = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {(i, 0) for i in range(1, 31)} | {(60, 50), (70, 50), (100, 50)}


def test_null_and_repeated_ids_are_linked_by_their_texts(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda n: " ".join([*base[:-1], f"x{n}"])
    rows = [(None, near(0)), (None, near(1)), (7, near(2)), (7, "another text of its own"), (7, near(3)), (3, " ".join(base)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 4, 85) == brute(rows, 4, 85)
    first = [r for r in J.classes(df).collect() if r["first"]]
    assert sorted(str((r.doc_id, r.component_id)) for r in first) == ["(3, 3)", "(7, 7)", "(None, None)"]


def test_short_texts_share_no_signature(spark):
    """Sets of few shingles are linked to equal ones only, and empty segments are no signatures: unrelated stubs don't meet."""
    stubs = spark.range(20_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 1 + id % 14), i -> concat('w', id * 14 + i))) AS text")
    for k, percent in ((4, 85), (5, 80)):
        signatures = J.grouped(J.indexed(stubs, k, percent, 16)).filter("signature IS NOT NULL")
        assert signatures.groupBy("signature").count().agg({"count": "max"}).head()[0] is None
