"""Stop lists, technical adjectives, correction where needed, feedback report on small literal tables."""

from pyspark.sql import functions as F

from korpora.operators import evaluation as E
from korpora.operators import feedback as B
from korpora.operators import terms as T
from korpora.plans.terms import noun_counts


def test_noun_lists(spark):
    s = spark.createDataFrame([("Die Welle und Dabei die Nut FIGUR Anspruch.",), ("Nut",), (None,)], "sentence string")
    plain = {r.token for r in noun_counts(s).collect()}
    listed = {r.token for r in noun_counts(s, stop=("DABEI",), skip=("Anspruch",)).collect()}
    assert plain == {"Welle", "Dabei", "Nut", "FIGUR", "Anspruch"} and listed == {"Welle", "Nut", "FIGUR"}


def test_technical_adjectives(spark):
    words = ["dehnbar", "dehnbare", "dehnbaren", "unbar", "xbar", "xyzbar", "teilweise", "gegeben", "erfindungsgemäß", "erfindungsgemäßes", "einmalig", "seltenbar"]
    df = spark.createDataFrame([(w,) for w in words for _ in range(1 if w == "seltenbar" else 2)] + [(None,)], "token string")
    got = {r.base: (r.frequency, r.variants) for r in T.technical_adjectives(df).collect()}
    assert got == {"dehnbar": (6, ["dehnbare", "dehnbaren"]), "xyzbar": (2, []), "erfindungsgemäß": (4, ["erfindungsgemäßes"])}


def test_corrected_where_needed(spark):
    schema = "id int, translation string, error_spans array<struct<confidence: double>>, violations array<string>"
    rows = [(1, "a", [(0.9,)], []), (2, "b", [(0.1,)], []), (3, "c", [], ["x=y"]), (4, "d", [(None,)], []), (5, None, [(0.5,)], [])]
    seen = []

    def correct(x):
        seen.extend(sorted(r.id for r in x.collect()))
        return x.withColumn("ape", F.when(F.col("id") == 1, "A"))

    got = {r.id: (r.ape, r.changed, r.skipped) for r in E.corrected_where_needed(spark.createDataFrame(rows, schema), correct).collect()}
    assert seen == [1, 3, 5]
    assert got == {1: ("A", True, False), 2: ("b", False, True), 3: ("c", False, False), 4: ("d", False, True), 5: (None, False, False)}


def test_report(spark):
    rows = [(i, True, "good" if i < 3 else "minor", "order") for i in range(4)] + [(10, True, "minor", "terms"), (11, False, "critical", None), (12, False, "good", "x"), (13, None, None, None)]
    df = spark.createDataFrame(rows, "id int, changed boolean, qe_rating string, edit_type string")
    got = [r.line for r in B.report(df, "id").orderBy("part", "k").collect()]
    assert got[0] == "Total confirmed segments: 8" and got[1:3] == ["  Accepted as-is: 2", "  Edited before confirming: 5"]
    assert got[4].endswith("edited): 3") and got[5].endswith("as-is): 1")
    assert got[6:] == ["  order: 4", "  terms: 1", "  order: 4 occurrences — QE catches 25.0% [NEEDS RULE]"]
    assert B.report(df.limit(0), "id").filter("part > 0").count() == 0


def test_conditions_are_asked_once_a_word(spark):
    tokens = spark.createDataFrame([("tragfähig",), ("tragfähige",), ("tragfähig",), ("tragfähige",)], "token string")
    for df in (T.technical_adjectives(tokens, ("fähig",)), T.suffix_terms(tokens, ("fähig",))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert max(plan.rfind("EndsWith"), plan.rfind("RLIKE")) < plan.rfind("Aggregate [token")
        assert [r.frequency for r in df.collect()] == [4]
