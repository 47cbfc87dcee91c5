"""Operators on small literal tables, boundaries included."""

import math
import random

import pytest
from pyspark.sql import functions as F

from korpora.functions import metrics as M
from korpora.functions import text as X
from korpora.operators import batching as B
from korpora.operators import corpus as C
from korpora.operators import evaluation as V
from korpora.operators import feedback as E
from korpora.operators import structure as S
from korpora.operators import terms as T
from korpora.operators import triage as Q


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).head().y


def test_sentences(spark):
    assert one(spark, "Dies ist der erste Satz hier.  Ölig ist der zweite Satz! kurz. Nun [ein] dritter Satz.", X.sentences) == ["Dies ist der erste Satz hier.", "Ölig ist der zweite Satz! kurz.", "Nun [ein] dritter Satz."]
    assert one(spark, "", X.sentences) == []


@pytest.mark.parametrize("word,lemma", [("Wellen", "well"), ("Haus", "haus"), ("Räder", "räder"), ("Rädern", "räder"), ("Kopf", "kopf"), ("gutes", "gute")])
def test_lemma(spark, word, lemma):
    assert one(spark, word, T.lemma) == lemma


def test_noun_base_strips_runs(spark):
    assert one(spark, "Fluss", T.noun_base) == "Flu"
    assert one(spark, "Ass", T.noun_base) == "Ass"


def test_compound_parts(spark):
    parts = one(spark, "Herzklappe", T.compound_parts)
    assert {"herz", "klappe"} <= set(parts)
    assert {"arbeit", "zimmer"} <= set(one(spark, "Arbeitszimmer", T.compound_parts))
    assert one(spark, "kurz", T.compound_parts) == []


@pytest.mark.parametrize(
    "src,ref,reason",
    [("", "x" * 20, "empty"), ("a" * 9, "b" * 20, "too_short"), ("a" * 10, "b" * 10, None), ("a" * 500, "b" * 500, None), ("a" * 501, "b" * 500, "too_long"), ("12345678ab", "b" * 10, "mostly_numbers"), ("123456abcd", "b" * 10, None), ("Gleicher Text", " gleicher text", "identical"), ("a" * 30, "b" * 10, None), ("a" * 31, "b" * 10, "length_ratio"), ("1" * 9, "b" * 10, "too_short"), (" " * 8 + "a" * 8, "b" * 20, "too_short"), ("a" * 500 + "\n ", "b" * 500, None), ("\t" * 20 + "a" * 20, "b" * 20, None), (None, "b" * 20, "empty")],
)
def test_reject_reason(spark, src, ref, reason):
    assert spark.createDataFrame([(src, ref)], "s string, r string").select(C.reject_reason(F.col("s"), F.col("r"))).head()[0] == reason


def test_align(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["x", "y"]), (2, ["a"], ["x", "y"]), (3, ["a"], ["x", "y", "z"]), (4, [], ["x"])], "id int, l array<string>, r array<string>")
    assert sorted(map(tuple, C.align(rows, "l", "r", "id").collect())) == [(1, 0, "a", "x"), (1, 1, "b", "y"), (2, 0, "a", "x")]


def test_split_is_exact(spark):
    out = C.split_by_rank(spark.range(1000).withColumnRenamed("id", "k"), "k").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"train": 800, "val": 100, "test": 100}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance(spark):
    r = random.Random(1)
    rows = [([r.choice("abc") for _ in range(r.randrange(8))], [r.choice("abc") for _ in range(r.randrange(8))]) for _ in range(60)] + [([], []), (["a"], []), ([], ["a", "b"])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", M.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(x.d == levenshtein(x.a, x.b) for x in got)
    ter = spark.createDataFrame([("a b", ""), ("a b c d", "x"), ("a", "a")], "h string, r string").select(M.ter(F.col("h"), F.col("r"))).collect()
    assert [x[0] for x in ter] == [1.0, 4.0, 0.0]


def test_bleu_and_chrf(spark):
    rows = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("a dog ran to the park", "a dog ran to the park")], "h string, r string")
    s = M.corpus_scores(M.ngram_statistics(rows, "h", "r")).head()
    assert math.isclose(s.bleu, 100) and math.isclose(s.chrf, 100)
    other = M.corpus_scores(M.ngram_statistics(rows.withColumn("h", F.lit("zz qq")), "h", "r")).head()
    assert other.bleu == 0 and other.chrf == 0


@pytest.mark.parametrize("rating,confidence,bucket", [("good", "high", "green"), ("good", "medium", "green"), ("good", "low", "orange"), ("good", "odd", "red"), ("good", None, "green"), ("minor", "high", "orange"), (None, None, "orange"), ("major", "low", "red"), ("critical", "high", "red"), ("strange", "high", "red")])
def test_bucket(spark, rating, confidence, bucket):
    assert spark.createDataFrame([(rating, confidence)], "r string, c string").select(Q.bucket(F.col("r"), F.col("c"))).head()[0] == bucket


def test_thresholds(spark):
    got = spark.createDataFrame([(0.82,), (0.8199,), (0.68,), (0.6799,)], "s double").select(Q.by_threshold(F.col("s"), 0.82, 0.68)).collect()
    assert [x[0] for x in got] == ["publish", "review", "review", "full_edit"]


@pytest.mark.parametrize("n", [1, 49, 50, 51, 95, 96, 140])
def test_overlapping_batches(spark, n):
    out = B.overlapping(spark.range(n).select(F.col("id").alias("idx"), F.lit(n).alias("n"))).collect()
    owners = [r for r in out if r.owner]
    assert sorted(r.idx for r in owners) == list(range(n))
    starts, at = [], 0
    while True:
        starts.append(at)
        if at + 50 >= n:
            break
        at += 45
    assert sorted({r.start for r in out}) == starts
    assert all(r.start == min(s for s in starts if s <= r.idx < s + 50) for r in owners)
    with pytest.raises(ValueError):
        B.overlapping(spark.range(1), 5, 5)


def test_answers():
    assert B.numbered("[1] a\nb\n[2] c", 2) == ["a\nb", "c"]
    assert B.numbered("1. a\n2. b", 2) == ["a", "b"]
    assert B.numbered("a\nb", 3) == ["a", "b", B.UNPARSED]
    assert B.json_rows('```json\n[{"rating": "good"}]\n```') == [{"rating": "good"}]
    assert B.json_rows('[{"rating": "good"}, {"rating": "mi') == [{"rating": "good"}]
    assert B.json_rows('well {"rating": "good"} and {"x": 1} then {"rating": "minor"') == [{"rating": "good"}]
    assert B.json_rows("nothing") == []


def test_halving():
    calls = []

    def call(items):
        calls.append(len(items))
        if len(items) > 4 or 7 in items:
            raise RuntimeError
        return [i * 10 for i in items]

    out = B.with_halving(call, list(range(12)))
    assert out[:6] == [0, 10, 20, 30, 40, 50] and out[7] is None and len(out) == 12


def test_edit_types(spark):
    rows = [(1, "the rotor is moved by the shaft and was turned", "the shaft moves the rotor and turns it"), (2, "a round housing part", "a round casing part"), (3, "short", "short text that says much more now"), (4, "the movement of the arm", "moving the arm"), (5, "the bolt finds use in a screw", "the bolt is used in a screw")]
    got = {r.id: r for r in E.edit_types(spark.createDataFrame(rows, "id int, mt string, corrected string")).collect()}
    assert "passive_to_active" in got[1].edit_types
    assert got[2].primary_type == "terminology_swap" and got[3].primary_type == "addition"
    assert "nominalization_to_verb" in got[4].edit_types and "calque_fix" in got[5].edit_types


def tokens(spark, *sentences):
    rows = [(1, s, i, t, t.lower(), pos, tag, dep, head) for s, sent in enumerate(sentences) for i, (t, pos, tag, dep, head) in enumerate(sent)]
    return spark.createDataFrame(rows, "doc_id long, idx int, i int, text string, lemma string, pos string, tag string, dep string, head_i int")


def test_structure(spark):
    nested = [
        ("Das", "DET", "ART", "nk", 1), ("Gerät", "NOUN", "NN", "sb", 2), ("zeigt", "VERB", "V", "ROOT", 2), (",", "PUNCT", "$", "punct", 2), ("dass", "SCONJ", "K", "cp", 9), ("die", "DET", "ART", "nk", 8), ("sich", "PRON", "P", "oa", 7),
        ("drehende", "ADJ", "ADJAPart", "nk", 8), ("Welle", "NOUN", "NN", "sb", 9), ("läuft", "VERB", "V", "oc", 2), (",", "PUNCT", "$", "punct", 9), ("die", "PRON", "PR", "sb", 12), ("bricht", "VERB", "V", "rc", 8), (".", "PUNCT", "$", "punct", 2),
    ]
    tiny = [("Ja", "ADV", "A", "ROOT", 0), (".", "PUNCT", "$", "punct", 0)]
    rows = {r.idx: r for r in S.scored(S.features(tokens(spark, nested, tiny))).collect()}
    r = rows[0]
    assert (r.n_tokens, r.clause_depth, r.vorfeld_length, r.n_relative_clauses) == (14, 2, 2, 1)
    assert (r.max_verb_final_span, r.n_verb_final_clauses) == (5, 1)
    assert (r.n_participial_constructions, r.max_participial_span) == (2, 3)
    assert math.isclose(r.risk_score, round(4 / 160 + 2 / 3 * 0.25 + 0.1 + 0.05 + 0.1, 3)) and r.risk_level == "medium"
    assert rows[1].risk_score == 0 and rows[1].risk_level == "low" and rows[1].risk_factors == []


def test_glossary(spark):
    s = spark.createDataFrame([(1, 0, "Die Nutmutter sitzt in der Minute."), (1, 1, "nichts")], "doc_id long, idx int, sentence string")
    hits = T.glossary_matches(s, [("Nut", "groove"), ("Nutmutter", "slot nut"), ("Rad", "wheel")])
    assert [(r.de, r.rank) for r in hits.orderBy("rank").collect()] == [("Nutmutter", 1), ("Nut", 2)]
    assert [r.de for r in T.glossary_matches(s, [("Nut", "groove"), ("Nutmutter", "slot nut")], whole_words=True).collect()] == ["Nutmutter"]
    p = spark.createDataFrame([("Die Nut", "the slot"), ("Die Nut", "the Groove")], "src string, mt string")
    assert [r.violations for r in T.glossary_violations(p, [("Nut", "groove")]).collect()] == [["Nut=groove"], []]
    look = T.three_stage_lookup(spark.createDataFrame([(1, 0, "Die Wellen der Herzklappe")], "doc_id long, idx int, sentence string"), [("Welle", "shaft"), ("Klappe", "valve"), ("Herzklappe", "heart valve")])
    assert {(r.stage, r.en) for r in look.collect()} == {(1, "shaft"), (1, "valve"), (1, "heart valve")}


def test_clusters(spark):
    n = spark.createDataFrame([(1, "Stent", 5), (1, "Stents", 3), (1, "Stenten", 1), (1, "Klappe", 2), (1, "Klappen", 2), (2, "Stents", 4)], "doc_id long, token string, total long")
    got = {(r.doc_id, r.term): (r.frequency, r.variants) for r in T.variant_clusters(n, "doc_id").collect()}
    assert got == {(1, "Stent"): (9, ["Stenten", "Stents"]), (1, "Klappe"): (4, ["Klappen"]), (2, "Stents"): (4, [])}


def test_mutations(spark):
    t = spark.createDataFrame([("a", "x", "s1"), ("b", "y", "s1")], "de string, en string, source string")
    new = spark.createDataFrame([("a", "x", "s1"), ("a", "x", "s2"), ("c", "z", "s1"), ("c", "z", "s1")], t.schema)
    assert C.insert_or_ignore(t, new, ["de", "en", "source"]).count() == 2
    assert "mt" in C.ensure_column(t, "mt").columns
    assert C.delete_and_insert(t, F.col("de") == "a", new.limit(1)).count() == 2
    assert C.within_budget(spark.createDataFrame([(1, "abc", 0), (2, "de", 0), (3, "f", 0)], "i int, t string, p int"), "t", "p", "i", 5).count() == 2


def test_prompts(spark):
    rows = spark.createDataFrame([(2, 0, "B satz", None, "low", 0.1), (1, 1, "C", "Split.", "high", 0.5), (1, 0, "A", "x", "low", 0.2)], "batch int, local int, sentence string, hint string, risk_level string, risk_score double")
    got = {r.batch: r.prompt for r in B.prompt(rows, ["batch"]).collect()}
    assert got[1].split("\n")[0] == "[1] A" and "[2] C\n   {STRUCTURAL NOTE (risk=high, score=0.50): Split.}" in got[1] and got[2] == "[1] B satz"
    ex = spark.createDataFrame([(2, "b" * 300, "t", "good", None), (1, "a", "t", "minor", "why")], "rank int, source string, translation string, rating string, explanation string")
    block = B.few_shot(ex).head().block
    assert block.startswith("Example 1:\nSource: a") and "b" * 201 not in block and "Why: why" in block
    assert B.layered_prompt("core", "", [("Nut", "groove")]) == "core\n\nUse these terms:\nNut = groove"
    assert B.cost(ex, "source").head().chars == 301


def test_provider(spark):
    s = spark.createDataFrame([(1, i, f"Satz {i}") for i in range(45)], "doc_id long, idx int, sentence string")
    assert B.provided(s, B.StubProvider()).filter("translation LIKE '<en> %' AND rating IS NOT NULL").count() == 45

    class Broken(B.StubProvider):
        def evaluate(self, pairs):
            raise RuntimeError("down")

    out = B.provided(s, Broken()).select("rating", "confidence").distinct().collect()
    assert [tuple(r) for r in out] == [("minor", "low")]


def test_answers_in_small_parts(spark):
    rows = [(k, ('{"rule_name": "r%d"}' % k) if k % 3 else "none", "t") for k in range(3 * B.FEW + 5)]
    got = B.parsed_proposals(spark.createDataFrame(rows, "k int, response string, type string").coalesce(1), "k").collect()
    assert {r.k: (r.rule_name, r.parsed) for r in got} == {k: (f"r{k}", True) if k % 3 else ("auto_t", False) for k, _, _ in rows}


def test_spans_are_routed_once(spark):
    span = "array<struct<confidence:double>>"
    s = spark.createDataFrame([(1, "e", [(0.9,)], []), (2, "e", [(0.1,)], []), (3, "e", [(None,)], ["v"])], f"k int, translation string, error_spans {span}, violations array<string>")
    df = V.corrected_where_needed(s, lambda x: x.withColumn("ape", F.replace("translation", F.lit("e"), F.lit("E"))))
    assert sorted((r.k, r.ape, r.skipped, len(r.real_errors)) for r in df.collect()) == [(1, "E", False, 1), (2, "e", True, 0), (3, "E", False, 0)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("filter(error_spans") == 2
