"""The inverted index against plain containment, and the three stages against a loop."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from korpora.functions import places as P
from korpora.operators import glossary as G
from korpora.operators.terms import LEMMA_ENDINGS, LINKS

TERMS = [("Nut", "groove"), ("nut", "slot"), ("Nutmutter", "slot nut"), ("die Nut", "the groove"), ("ab", "x"), ("b", "y"), ("  Rad  ", "wheel"), ("", "none"), (" ", "none"), ("der Welle an", "of the shaft"), ("é", "e"), ("a.b", "dot"), ("zz zz", "never"), ("le an der", "cut words"), ("Welle", None)]


@pytest.fixture(scope="module")
def sentences(spark):
    rng = random.Random(3)
    words = ["die", "Nut", "Nutmutter", "der", "Welle", "an", "Rad", "é", "a.b", "Zz", "ab", "b", ""]
    rows = [(i // 7, i % 7, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(120)]
    return spark.createDataFrame([*rows, (99, 0, None), (99, 1, "xab cab"), (99, 2, "Welle an der Welle an der")], "doc_id long, idx int, sentence string").selectExpr("*", "1 AS key", "'x' AS word")


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "de string, en string")


def fits(sentence, de):
    return bool(de.strip()) and de.strip().lower() in (sentence or "").lower()


def test_matches_are_all_substrings(sentences, terms):
    got = {(r.doc_id, r.idx, r.key) for r in G.matches(sentences, G.keyed(terms)).collect()}
    assert got == {(r.doc_id, r.idx, de.strip().lower()) for r, (de, _) in itertools.product(sentences.collect(), TERMS) if fits(r.sentence, de)}
    assert G.matches(sentences, G.keyed(terms).limit(0)).count() == 0 == G.matches(sentences.limit(0), G.keyed(terms)).count()


def test_short_and_random_terms(spark):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    s = [(i, 0, make(rng.randrange(12))) for i in range(150)]
    t = sorted({make(rng.randrange(1, 7)).strip() for _ in range(200)} - {""})
    got = G.matches(spark.createDataFrame(s, "doc_id long, idx int, sentence string"), spark.createDataFrame([(x,) for x in t], "key string"))
    want = sorted((i, x) for i, _, text in s for x in t if x in text)
    assert sorted((r.doc_id, r.key) for r in got.collect()) == want


def test_large_indexes_come_in_shards(sentences, terms):
    small, large = (sorted(map(tuple, G.matches(sentences, G.keyed(terms), limit=n).collect())) for n in (G.BROADCAST_BYTES, 100))
    assert small == large != []


def test_terms_longer_than_a_gram(spark):
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("ab 🙂é") for _ in range(n))
    texts = [make(60) for _ in range(60)]
    t = sorted({x[i : i + n].strip() for x in texts for i, n in [(rng.randrange(50), rng.randrange(1, 14))]} | {"never in the text"})
    got = G.matches(spark.createDataFrame([(i, 0, x) for i, x in enumerate(texts)], "doc_id long, idx int, sentence string"), spark.createDataFrame([(x,) for x in t], "key string"))
    assert sorted((r.doc_id, r.key) for r in got.collect()) == sorted((i, x) for i, text in enumerate(texts) for x in t if x and x in text)


def test_longest_first(sentences, terms):
    got = {}
    for r in G.longest_matches(sentences, terms, 3).orderBy("rank").collect():
        got.setdefault((r.doc_id, r.idx), []).append((r.de, r.en))
    for r in sentences.collect():
        want = sorted(((-len(de.strip()), de, en is not None, en or "") for de, en in TERMS if fits(r.sentence, de)))[:3]
        assert got.get((r.doc_id, r.idx), []) == [(de, en if known else None) for _, de, known, en in want]


def test_violations(spark, terms):
    pairs = spark.createDataFrame([(1, 0, "Die Nut", "the GROOVE"), (1, 1, "Nutmutter", "nut"), (2, 0, "Rad", None), (3, 0, None, "x"), (4, 0, "nichts", "nothing")], "doc_id long, idx int, src string, mt string")
    got = {(r.doc_id, r.idx): r.violations for r in G.violations(pairs, terms.filter("en IS NOT NULL AND length(trim(de)) > 2")).collect()}
    assert got == {(1, 0): ["nut=slot"], (1, 1): ["Nut=groove", "Nutmutter=slot nut", "nut=slot"], (2, 0): ["  Rad  =wheel"]}


def stages(sentence, terms, most):
    def lemma(w):
        return next((w[: -len(s)] for s in LEMMA_ENDINGS if w.endswith(s) and len(w) > len(s) + 3), w)

    def parts(w):
        out = set()
        for i in range(4, len(w) - 3):
            out |= {w[: i - len(x)] for x in LINKS if w[:i].endswith(x) and i - len(x) >= 4} | {w[i:]}
        return sorted(out)

    exact, by_lemma = {}, {}
    for de, en in sorted(terms):
        exact.setdefault(de.lower(), []).append((de, en))
        if " " not in de:
            by_lemma.setdefault(lemma(de.lower()), []).append((de, en))
    low, out = sentence.lower(), []

    def take(stage, options):
        free = [o for o in options if o[1].lower() not in {e.lower() for _, _, e in out}]
        if free and len(out) < most:
            out.append((stage, *free[0]))

    for key in sorted(exact, key=lambda k: (-len(k), k)):
        if key in low:
            take(1, exact[key])
    ws = re.findall(r"\w+", low)
    for w in ws:
        take(2, by_lemma.get(lemma(w), []))
    for w in ws:
        if len(w) >= 8:
            take(3, next((by_lemma[lemma(p)] for p in parts(w) if lemma(p) in by_lemma), []))
    return out


def test_three_stages_as_a_loop(spark):
    terms = [("Welle", "shaft"), ("Welle", "wave"), ("Wellen", "Shaft"), ("Klappe", "valve"), ("Herz", "heart"), ("Herzklappe", "heart valve"), ("die Klappe", "the flap"), ("Räder", "wheels"), ("Lager", "bearing"), ("Kugel", "ball")]
    rng = random.Random(9)
    vocabulary = ["Die", "Wellen", "Welle", "der", "Herzklappen", "Kugellager", "Klappen", "Herz", "Zahnräder", "Räder", "Wellenlager", "Lagers", "die", "Klappe", "Kugelherzen"]
    rows = [(i, 0, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 8)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, idx int, sentence string")
    for most in (2, 5):
        got = {}
        for r in G.lookup(df, spark.createDataFrame(terms, "de string, en string"), most).orderBy("rank").collect():
            got.setdefault(r.doc_id, []).append((r.stage, r.de, r.en))
        assert got == {i: s for i, _, text in rows if (s := stages(text, terms, most))}


def test_only_places_of_terms_become_rows():
    texts = pa.array(["", "die nutmutter", "nutm", "é nutmutter nutmutter", "zz"])
    codes, n, row = P.codes_of(pa.array(["nutmutte", "zz"]))
    assert (n.tolist(), row.tolist()) == ([8, 2], [0, 1])
    bits = 12
    table = np.zeros(1 << bits - 6, np.int64)
    for b in P.marks(bits)([pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64))], ["code"])]):
        table[b.column("word").to_numpy()] |= b.column("bits").to_numpy()
    out = list(P.placed([2, 8], table, bits)([pa.RecordBatch.from_arrays([pa.array(range(5)), texts], ["id", "_low"])]))
    got = {r["id"]: set(r["codes"]) for b in out for r in b.to_pylist()}
    assert {i: c & set(codes.view(np.int64).tolist()) for i, c in got.items()} == {1: {int(codes.view(np.int64)[0])}, 3: {int(codes.view(np.int64)[0])}, 4: {int(codes.view(np.int64)[1])}}


def test_texts_are_not_spelt_out(sentences, terms):
    df = G.matches(sentences, G.keyed(terms))
    assert "regexp_extract_all" not in df._jdf.queryExecution().analyzed().toString()  # before, each place of each text became a row


def test_sentences_are_split_once(spark):
    docs = spark.createDataFrame([(1, "Die Nut ist in der Nutmutter. Die Welle dreht sich im Lager.")], "doc_id long, text string")
    sentences = docs.selectExpr("doc_id", "posexplode(split(text, '(?<=[.]) ')) AS (idx, sentence)")
    df = G.lookup(sentences, spark.createDataFrame([("Nutmutter", "slot nut"), ("Lager", "bearing")], "de string, en string"))
    assert "split(" not in df._jdf.queryExecution().analyzed().toString()  # before, each of the three stages split the texts anew
    assert sorted(map(tuple, df.collect())) == [(1, 0, 1, 1, "Nutmutter", "slot nut"), (1, 1, 1, 1, "Lager", "bearing")]
