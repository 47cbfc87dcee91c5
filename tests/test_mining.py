"""Mining against plain loops over few pairs, with nulls, numbers, ties and repeated rows."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from korpora.functions import lexicons as W
from korpora.operators import mining as M
from korpora.operators import terms as T


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(11)
    german, english = ["Rastaufnahme", "Welle", "Nut", "der", "und", "Klappe", "Herz", "2024", "neben", "sehr"], ["receptacle", "shaft", "the", "groove", "of", "valve", "heart", "2024", "beside", "Nut"]
    slips = {"receptacle": "picture", "shaft": "wave", "valve": "flap"}
    rows = []
    for i in range(300):
        k = [rng.randrange(len(german)) for _ in range(rng.randrange(1, 9))]
        ref = " ".join(english[j] for j in k)
        rows.append((i, " ".join(german[j] for j in k), " ".join(slips.get(w, w) if rng.random() < 0.8 else w for w in ref.split()), ref))
    rows += [(300, None, "a picture", "a receptacle"), (301, "Nut", None, "groove"), (302, "Nut", "slot", None), (303, "", "", ""), (304, "Welle Welle", "x1 " * 3 + " ".join(f"odd{i}" for i in range(20)), "shaft")]
    return spark.createDataFrame(rows, "id long, src string, mt string, ref string").selectExpr("*", "1 AS frequency", "2 AS k", "'x' AS gone", "3 AS n")


def words(text):
    return list(dict.fromkeys(re.findall(r"\w+", (text or "").lower())))


def triples(rows, min_frequency=5, min_consistency=0.5, most=15):
    total, freq, source = Counter(), Counter(), defaultdict(Counter)
    for r in rows:
        m, f = words(r.mt), words(r.ref)
        keep = lambda own, other: [w for w in own if w not in other and w not in W.ENGLISH_STOPWORDS and len(w) >= 3 and not w.isdigit()]
        gone, new = keep(m, f), keep(f, m)
        if max(len(gone), len(new)) > most:
            continue
        total.update(gone)
        for a in gone:
            for b in new:
                freq[a, b] += 1
                source[a, b].update(w for w in words(r.src) if len(w) >= 4 and w not in W.GERMAN_STOPWORDS)
    found = []
    for (a, b), n in freq.items():
        top = sorted(source[a, b].items(), key=lambda x: (-x[1], x[0]))[:5]
        if n < min_frequency or n / total[a] < min_consistency or not top:
            continue
        pick = top[0] if top[0][1] / n >= 0.3 else next((t for t in top if len(t[0]) >= 5 and t[1] / n >= 0.15), None)
        if pick:
            found.append((pick[0], b, a, n, n / total[a], pick[1] / n))
    best = {}
    for r in sorted(found, key=lambda r: (-r[3], -r[4], r[2], r[1])):
        best.setdefault(r[0], r)
    return sorted(best.values())


def test_triples(pairs):
    for args in ({}, {"min_frequency": 2, "min_consistency": 0.1}, {"min_frequency": 1, "min_consistency": 0.01, "most": 3}):
        got = M.correction_triples(pairs, **args).collect()
        assert sorted(map(tuple, got)) == triples(pairs.collect(), **args)
        assert args or got
    assert M.correction_triples(pairs.limit(0)).count() == 0


def test_term_pairs(pairs):
    want = []
    freq, beside = Counter(), defaultdict(Counter)
    for r in pairs.collect():
        s, t = [w for w in words(r.src) if w not in W.GERMAN_TERM_STOPWORDS], [w for w in words(r.ref) if w not in W.ENGLISH_TERM_STOPWORDS]
        if 2 <= len(s) <= 5 and 2 <= len(t) <= 5:
            for w in s:
                if len(w) >= 4:
                    freq[w] += 1
                    beside[w].update(x for x in t if len(x) >= 3)
    for w, n in freq.items():
        x, k = min(beside[w].items(), key=lambda i: (-i[1], i[0]), default=(None, 0))
        if n >= 10 and k / n >= 0.5 and x != w and not w.isdigit() and not x.isdigit():
            want.append((w, x, n, k / n))
    assert sorted(map(tuple, M.term_pairs(pairs, min_consistency=0.5, sizes=(2, 5)).collect())) == sorted(want) != []


def test_shares_of_term_pairs_are_counted_as_one(pairs):
    args = {"min_frequency": 10, "min_consistency": 0.3, "sizes": (2, 5)}
    want = sorted(map(tuple, M.term_pairs(pairs, **args).collect()))
    assert len(want) > 1
    for share, products in ((1, 100), (7, 50), (40, 1000)):
        assert sorted(map(tuple, M.term_pairs(pairs, **args, share=share, products=products).collect())) == want
    assert M.term_pairs(pairs.limit(0)).count() == 0


def test_a_term_pair_of_uneven_shares(spark):
    rows = [(i, "welle neben lager", f"shaft word{i} thing{i}" if i % 2 else f"other{i} word{i} thing{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, src string, ref string")
    got = M.term_pairs(df, (), (), 5, 0.5, (1, 9), share=3, products=10).collect()
    assert sorted(map(tuple, got)) == [(w, "shaft", 40, 0.5) for w in ("lager", "neben", "welle")]  # at the limit to the row


def test_bigrams(pairs):
    total, beside = Counter(), defaultdict(Counter)
    for r in pairs.collect():
        grams = lambda x: list(dict.fromkeys(map(" ".join, itertools.pairwise(re.findall(r"\w+", (x or "").lower())))))
        m, f = grams(r.mt), grams(r.ref)
        own = lambda a, b: [g for g in a if g not in b and not all(w in W.ENGLISH_STOPWORDS for w in g.split())]
        gone, new = own(m, f), own(f, m)
        if len(gone) <= 10 and len(new) <= 10:
            for g in gone:
                total[g] += 1
                beside[g].update(new)
    want = []
    for g, n in total.items():
        if n >= 5 and beside[g]:
            x, k = min(beside[g].items(), key=lambda i: (-i[1], i[0]))
            if k >= 3 and k / n >= 0.4:
                want.append((g, x, k, k / n))
    assert sorted(map(tuple, M.bigram_corrections(pairs).collect())) == sorted(want) != []


def test_words_of_bigrams_are_found_once_a_text(spark):
    df = T.corrections(spark.createDataFrame([(" ".join(f"w{i}" for i in range(9)), "w0 w1")] * 2 + [("a b", "a c"), ("a b", "a c"), (None, "x y")], "mt string, ref string"), grams=True, min_total=2, min_together=2)
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 4  # two texts, read for totals and for counts
    assert sorted(map(tuple, df.collect())) == [("a b", 2, "a c", 2, 1.0)]


def corrected(rows, unit, min_total, min_together, min_consistency):
    total, beside = Counter(), defaultdict(Counter)
    for mt, ref in rows:
        if mt is not None and ref is not None:
            m, r = unit(mt), unit(ref)
            for g in [g for g in m if g not in r]:
                total[g] += 1
                beside[g].update(x for x in r if x not in m)
    best = [(g, n, *max(beside[g].items(), key=lambda i: (i[1], i[0]))) for g, n in total.items() if beside[g]]
    return sorted((g, n, x, k, k / n) for g, n, x, k in best if n >= min_total and k >= min_together and k / n >= min_consistency)


def test_whole_corrections(spark, pairs):
    rows = [(r.mt, r.ref) for r in pairs.collect()]
    many = " ".join(f"w{i}" for i in range(40))
    rows += [(f"{many} alone{i}", f"v0 {many.replace('w', 'v')} v0") for i in range(3)] + [("only here", ""), ("picture", ""), ("", "nothing"), ("a from", "a of"), ("a from", "a of an")]
    df = spark.createDataFrame(rows, "mt string, ref string")
    grams = lambda x: list(dict.fromkeys(map(" ".join, itertools.pairwise(re.findall(r"\w+", x.lower())))))
    for of_grams, unit in ((False, words), (True, grams)):
        for limits in ((5, 3, 0.4), (2, 2, 0.4), (1, 1, 0.01), (1, 1, 1.0)):
            got = sorted(map(tuple, T.whole_corrections(df, of_grams, *limits).collect()))
            assert got == corrected(rows, unit, *limits) != []
            assert ("w1 w2" if of_grams else "w1") in {g[0] for g in got} or limits[0] == 5
    assert T.whole_corrections(df.limit(0)).count() == 0


def test_long_pairs_are_not_multiplied_out(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(20_000))
    df = spark.createDataFrame([(text("a"), text("b"))] * 2 + [(text("c"), text("d"))], "mt string, ref string")
    got = T.whole_corrections(df, True, 2, 2).select("right", "total", "together").distinct().collect()
    assert list(map(tuple, got)) == [(max(f"b{i} b{i + 1}" for i in range(19_999)), 2, 2)]
