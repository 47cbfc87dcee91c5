"""Metrics against the standard library and plain loops."""

import random
from collections import Counter
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from korpora.functions import metrics as M

few = st.text(alphabet="ab c", max_size=40)
many = st.text(alphabet=st.characters(min_codepoint=0x4E00, max_codepoint=0x4E40), max_size=60)


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(few, few)
def test_distance(a, b):
    assert M.distance(a, b) == plain(a, b) == M.distance(list(a), list(b))


def test_distance_of_long_sequences():
    rng = random.Random(1)
    a = [rng.choice("abcdef") for _ in range(700)]
    b = [x for x in a if rng.random() < 0.9] + ["z"] * 30
    assert M.distance(a, b) == plain(a, b)


@settings(max_examples=300, deadline=None)
@given(st.one_of(few, many), st.one_of(few, many))
def test_ratio_as_the_library(a, b):
    assert M.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def variants(rng, alphabet, n):
    a = "".join(rng.choice(alphabet) for _ in range(n))
    b = list(a)
    for _ in range(n // 8):
        i = rng.randrange(len(b))
        b[i : i + rng.randrange(4)] = [rng.choice(alphabet) for _ in range(rng.randrange(4))]
    return a, "".join(b)


def test_ratio_with_popular_characters_and_large_alphabets():
    rng = random.Random(4)
    for alphabet in ("ab", "etaoin shrdlu cmfwyp", "".join(map(chr, range(0x4E00, 0x4E00 + 150))), "e" * 30 + "xyzqj ."):
        for n in (150, 199, 200, 201, 900):
            a, b = variants(rng, alphabet, n)
            assert M.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_both_searches_agree():
    rng = random.Random(6)
    for _ in range(200):
        a, b = variants(rng, rng.choice(["ab", "abcdefgh", "éü🙂x"]), rng.randrange(1, 40))
        x = M.Blocks(a, b)
        lo = rng.randrange(len(b) + 1)
        args = (x.telling, 0, lo, rng.randrange(lo, len(b) + 1))
        assert x.by_pairs(*args) == x.by_automaton(*args)


def counts(h, r):
    def grams(x, n):
        return Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))

    hw, rw, hc, rc = h.split(), r.split(), "".join(h.split()), "".join(r.split())
    word = [sum((grams(hw, n) & grams(rw, n)).values()) for n in range(1, 5)]
    char = [sum((grams(hc, n) & grams(rc, n)).values()) for n in range(1, 7)]
    return len(hw), len(rw), word, [max(len(hw) - n, 0) for n in range(4)], char, [max(len(hc) - n, 0) for n in range(6)], [max(len(rc) - n, 0) for n in range(6)]


def test_ngrams_as_counters(spark):
    rng = random.Random(8)
    make = lambda: " ".join(rng.choice(["a", "b", "the", "cat", "🙂", "é", "x y"]) for _ in range(rng.randrange(12)))
    rows = [(i, make(), make()) for i in range(200)] + [(200, None, "a"), (201, "a", None), (202, None, None), (203, "", " \t"), (204, "same text here", "same text here"), (205, "".join(map(chr, range(0x4E00, 0x4E00 + 3000))), "一丁 七" * 500)]
    for some in (rows, rows * 300, rows[:1], rows[200:203], []):
        df = spark.createDataFrame(some, "id long, h string, r string").coalesce(1)
        found = M.ngram_statistics(df, "h", "r", "id").collect()
        assert len(found) == len(some)
        got = {x.id: tuple(x[1:]) for x in found}
        assert got == {i: counts(h or "", r or "") for i, h, r in some}
