"""Sessions, references, splits of changed rows and proposals on small literal tables."""

import pytest

from korpora.operators import batching as B
from korpora.operators import corpus as C
from korpora.operators import terms as T
from korpora.operators import triage as Q


def test_session_log_keeps_confirmed_only(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, None, None), (3, "c", "z")], "index int, source string, translation string")
    c = spark.createDataFrame([(1, "X"), (2, "Y"), (3, None)], "index int, confirmed_text string")
    q = spark.createDataFrame([(1, "good", "none", 1), (1, "critical", "omission", 3), (1, "minor", "grammar", 2)], "index int, rating string, error_category string, at int")
    got = {tuple(r) for r in Q.session_log(t, c, q, "at").collect()}
    assert got == {(1, "a", "x", "X", "critical", "omission", "unknown"), (2, "", "", "Y", "unknown", "", "unknown")}


def test_reference_beyond_the_last(spark):
    mt = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, mt string")
    ref = spark.createDataFrame([(0, "A")], "idx int, reference string")
    assert [r.reference for r in Q.with_reference(mt, ref, "idx").orderBy("idx").collect()] == ["A", "(no reference available)"]


@pytest.mark.parametrize("n,val", [(0, 0), (1, 1), (19, 1), (40, 4)])
def test_split_changed(spark, n, val):
    rows = spark.createDataFrame([(i, True) for i in range(n)] + [(100, False), (101, None)], "id long, changed boolean")
    got = [r.split for r in C.split_changed(rows, "id").collect()]
    assert (len(got), got.count("val")) == (n, val)


def test_within_ter_exempts_test(spark):
    rows = spark.createDataFrame([("train", 0.5), ("train", 0.6), ("val", None), ("test", 0.9), (None, 0.1)], "split string, ter double")
    assert {tuple(r) for r in C.within_ter(rows).collect()} == {("train", 0.5), ("test", 0.9), (None, 0.1)}


def test_unscored(spark):
    assert tuple(Q.unscored(spark.range(1)).head()) == (0, 0.75, "review")


def test_by_strength(spark):
    rows = spark.createDataFrame([("b", "x", 4, 0.5), ("a", "y", 4, 0.5), ("c", "z", 9, 0.9)], "term string, partner string, frequency int, consistency double")
    assert [r.term for r in T.by_strength(rows).collect()] == ["c", "a", "b"]


@pytest.mark.parametrize("text,want", [
    ('```json\n{"a": 1}\n```', {"a": 1}), ('say {"a": {"b": 2}} end', {"a": {"b": 2}}), ("[1]", None), ("", None), ("} {", None), ('{"a": ', None),
])
def test_json_object(text, want):
    assert B.json_object(text) == want


def test_parsed_proposals(spark):
    rows = spark.createDataFrame([(1, '{"rule_name": "r", "severity": "major"}', "t"), (2, " prose ", "t"), (3, None, "t")], "id int, response string, type string")
    got = [tuple(r)[1:] for r in B.parsed_proposals(rows, "id").orderBy("id").collect()]
    assert got[0] == ("r", None, None, None, "major", None, True)
    assert got[1] == ("auto_t", "qe", "UNKNOWN", "prose", "minor", "failed to parse the answer", False)
    assert got[2][3] == "" and not got[2][-1]
