"""Features over token tables against walks in plain Python; chains of any depth, circles, missing heads."""

import random

import pytest

from korpora.operators import parsing as P

SCHEMA = "doc_id long, idx int, i int, text string, pos string, tag string, dep string, head_i int"


def brute(tokens):
    """Features of one sentence, from its rows in order."""
    n = len(tokens)
    head = [t.head_i if t.head_i is not None and 0 <= t.head_i < n else t.i for t in tokens]
    opens = [t.dep in ("rc", "cp", "oc", "re", "cj") or t.pos == "SCONJ" for t in tokens]
    depth = 0
    for i in range(n):
        at, count, steps = i, 0, 0
        while head[at] != at and steps <= n:
            at = head[at]
            count += opens[at]
            steps += 1
        if steps <= n:
            depth = max(depth, count)
    spans, parts = [], []
    for t in tokens:
        if t.pos == "SCONJ" or (t.dep == "rc" and t.pos in ("PRON", "DET")):
            last = None
            for u in tokens[t.i + 1 :]:
                if u.text in (".", ";") or (u.text == "," and u.i > t.i + 3):
                    break
                last = u.i if u.pos in ("VERB", "AUX") else last
            if last is not None and last - t.i > 2:
                spans.append(last - t.i)
        if t.pos == "ADJ" and tokens[head[t.i]].pos in ("NOUN", "PROPN"):
            children = [u for u in tokens if u.head_i == t.head_i and u.i != u.head_i]
            rules = []
            if "Part" in (t.tag or ""):
                rules.append(lambda u: u.dep == "det" or (u.dep == "nk" and u.pos == "DET"))
            if t.text.lower().endswith(("end", "ende", "enden", "ender", "endes", "endem")):
                rules.append(lambda u: u.dep in ("det", "nk") and u.pos == "DET")
            for rule in rules:
                det = next((u for u in children if rule(u) and u.i < t.i), None)
                if det and t.i - det.i > 2:
                    parts.append(t.i - det.i)
    relative = sum(t.dep == "rc" or (t.text.lower().startswith("welch") and t.dep in ("sb", "oa")) for t in tokens)
    pattern = any(a.text == "," and b.text.lower() in P.RELATIVE and b.pos in ("PRON", "DET") and b.dep != "det" for a, b in zip(tokens, tokens[1:]))
    root = next((t for t in tokens if t.dep == "ROOT"), None)
    return n, depth, max(spans, default=0), len(spans), max(relative, int(pattern)), len(parts), max(parts, default=0), root.i if root and root.pos in ("VERB", "AUX") else 0


def same(df):
    by = {}
    for r in df.orderBy("i").collect():
        by.setdefault((r.doc_id, r.idx), []).append(r)
    assert {(r[0], r[1]): tuple(r[2:]) for r in P.clause_features(df).collect()} == {k: brute(v) for k, v in by.items()}


def test_random_trees(spark):
    rng = random.Random(2)
    rows = []
    for d in range(120):
        n = rng.randrange(1, 25)
        order = rng.sample(range(n), n)
        for k, i in enumerate(order):
            head = order[rng.randrange(k)] if k else i
            pos, dep = rng.choice(["SCONJ", "PRON", "DET", "VERB", "AUX", "ADJ", "NOUN", "X"]), rng.choice(["rc", "cp", "oc", "re", "cj", "sb", "oa", "nk", "det", "mo"])
            rows.append((d, d % 3, i, rng.choice([",", ".", ";", "die", "welche", "laufende", "Ding", "dem"]), pos, rng.choice(["A|Part", "B", None]), "ROOT" if head == i else dep, head))
    same(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS t", "'x' AS root"))


def test_chains_circles_and_missing_heads(spark):
    chain = [(1, 0, i, "w", "SCONJ", None, "cp", max(i - 1, 0)) for i in range(1000)]
    circle = [(2, 0, 0, "a", "SCONJ", None, "cp", 1), (2, 0, 1, "b", "SCONJ", None, "cp", 0), (2, 0, 2, "c", "SCONJ", None, "cp", 2), (2, 0, 3, "d", "X", None, "mo", 2)]
    missing = [(3, 0, 0, "a", "X", None, None, None), (3, 0, 1, "b", None, None, "oc", 9), (3, 0, 2, None, "VERB", None, "mo", 1)]
    df = spark.createDataFrame(chain + circle, SCHEMA)
    same(df)
    got = {r.doc_id: r.clause_depth for r in P.clause_features(spark.createDataFrame(chain + circle + missing, SCHEMA)).collect()}
    assert got == {1: 999, 2: 1, 3: 1}
    assert P.clause_features(df.limit(0)).count() == 0


def test_rules_give_trees(spark):
    texts = ["Die Wellen, die in dem Gehäuse laufende Teile tragen, sind da, weil wir das sagen.", "", None, "...", "Ding", "das das das und und und", "that that that as que si wenn " * 40]
    df = P.rule_parsed(spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, idx int, sentence string"))
    by = {}
    for r in df.orderBy("i").collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {0, 3, 4, 5, 6}
    for own in by.values():
        assert [r.i for r in own] == list(range(len(own))) and sum(r.head_i == r.i for r in own) == sum(r.dep == "ROOT" for r in own) == 1
        for r in own:
            seen = set()
            while r.head_i != r.i:
                assert r.i not in seen
                seen.add(r.i)
                r = own[r.head_i]
    same(df)


def test_explained_with_figures(spark):
    row = lambda **k: {"doc_id": 1, "idx": 0, "n_tokens": 40, "clause_depth": 0, "max_verb_final_span": 0, "n_verb_final_clauses": 0, "n_relative_clauses": 0, "n_participial_constructions": 0, "max_participial_span": 0, "vorfeld_length": 0} | k
    df = spark.createDataFrame([row(clause_depth=3, max_verb_final_span=7, vorfeld_length=9), row(idx=1, n_tokens=3, clause_depth=5), row(idx=2, n_tokens=60), row(idx=3, n_relative_clauses=1, clause_depth=1)])
    got = {r.idx: r for r in P.explained(df).collect()}
    assert got[0].risk_factors == ["long sentence (40 tokens)", "clause depth 3", "verb-final span of 7 tokens", "long Vorfeld (9 tokens)"] and got[0].risk_level == "high"
    assert "nested 3 deep" in got[0].translation_hint and "9 tokens stand" in got[0].translation_hint
    assert (got[1].risk_factors, got[1].risk_score, got[1].translation_hint) == ([], 0.0, None)
    assert got[2].translation_hint == "The sentence has 60 tokens: put the key information first."


@pytest.mark.parametrize("least", [0, 1])
def test_nouns(spark, least):
    words = [("Die", "DET"), ("grüne", "ADJ"), ("Welle", "NOUN"), ("Nut", "NOUN"), ("Am", "NOUN"), ("läuft", "VERB"), ("Welle", "NOUN"), (",", "PUNCT"), ("Nut", "X"), ("Folgenden", "NOUN"), ("A", "NOUN"), ("FIG", "NOUN"), ("Sie", "NOUN")]
    df = spark.createDataFrame([(1, least, i, w, p, None, "x", 0) for i, (w, p) in enumerate(words)], SCHEMA)
    assert sorted(map(tuple, P.tagged_nouns(df).collect())) == [("Am", 1, 1), ("Folgenden A FIG Sie", 1, 1), ("Welle", 2, 2), ("Welle Nut Am", 1, 1)]


def test_features_without_a_shuffle(spark):
    texts = ["Die Wellen, die in dem Gehäuse laufende Teile tragen, sind da, weil wir das sagen.", "", None, "...", "Ding", "ein bald verschwindende Ding, welche oft war; dass", "that that as que si wenn " * 40, "ÄÖÜ ß İ Σας, der"]
    s = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts * 3)], "doc_id long, idx int, sentence string")
    got = P.rule_features(s)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, P.clause_features(P.rule_parsed(s)).select(got.columns).collect()))
