"""Hints with dropout, updates by line, counts of inserts and stems on small tables."""

import pytest
from pyspark.sql import functions as F

from korpora.operators import augment as A
from korpora.operators import corpus as C


def test_hints(spark):
    n = 4000
    s = spark.range(n).selectExpr("id AS doc_id", "int(id % 3) AS idx", "1 AS rank", "'x' AS hint")
    found = [(i, i % 3, k + 1, f"d{k}", f"e{k}") for i in range(n) for k in range(i % 4)]
    rows = A.with_hints(s, spark.createDataFrame(found, "doc_id long, idx int, rank int, de string, en string")).collect()
    assert len(rows) == n
    for r in rows:
        kept = [x for x in r.hint.removeprefix(" || terms: ").split("; ") if x]
        assert r.num_terms == r.doc_id % 4 and len(kept) == r.n_kept and len(set(kept)) == len(kept)
        assert {"none": r.num_terms == 0, "dropped": r.num_terms > 0 == r.n_kept, "all": kept == [f"d{k}=e{k}" for k in range(r.num_terms)], "some": 1 <= r.n_kept <= r.num_terms > 1}[r.mode]
    some = [r for r in rows if r.num_terms > 0]
    assert 0.22 < sum(r.mode == "dropped" for r in some) / len(some) < 0.28
    more = [r for r in some if r.num_terms > 1 and r.mode != "dropped"]
    assert 0.26 < sum(r.mode == "some" for r in more) / len(more) < 0.34
    assert {r.n_kept for r in more if r.mode == "some" and r.num_terms == 3} == {1, 2, 3}


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_no long, line string")


def test_update_by_lines(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, mt string")
    got = C.update_by_lines(rows, lines(spark, ["3", "", " 2 ", "9", "3"]), lines(spark, ["x ", "y", "z", "w"]), "id", "mt")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "y"), (3, "w")]
    with pytest.raises(ValueError, match="2 ids and 1 texts"):
        C.update_by_lines(rows, lines(spark, ["1", "2"]), lines(spark, ["x"]), "id", "mt")


def test_counts(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert tuple(C.insert_counts(old, new, ["k"]).head()) == (2, 2)
    assert tuple(C.insert_counts(old, new.limit(0), ["k"]).head()) == (0, 0)
    texts = spark.createDataFrame([("Ein Stent",), ("stent, VALVE",), (None,), ("nichts",)], "text string")
    assert {r.stem: r.n for r in C.stem_counts(texts, "text", ("stent", "valve", "bone", "stent")).collect()} == {"stent": 2, "valve": 1, "(any)": 2}


def test_hashes_of_large_keys(spark):
    keys = [0, 7, 433_000, 10**9, 9 * 10**15, 2**62 + 5, -3]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", C.hash_order(F.col("k"), 42).alias("h")).collect()
    assert {r.k: r.h for r in rows} == {k: (k * 2654435761 + 42) % 2**32 for k in keys}
    s = spark.createDataFrame([(k, 1) for k in keys[:-1]], "doc_id long, idx int")
    found = s.selectExpr("*", "explode(array(1, 2)) AS rank").selectExpr("*", "'a' AS de", "'b' AS en")
    assert {r.num_terms for r in A.with_hints(s, found).collect()} == {2}
