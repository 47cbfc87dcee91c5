"""Runs character by character, lines of odd segments, corpora cut after the filter."""

import random

from korpora.operators import corpora as C
from korpora.operators import report as R
from korpora.operators.corpus import reject_reason

SPANS = "array<struct<start: int, end: int, severity: string>>"


def test_runs_as_characters(spark):
    rng = random.Random(12)
    rows = []
    for i in range(150):
        n = rng.randrange(0, 15)
        spans = [(rng.randrange(-3, 16), rng.randrange(-3, 20), rng.choice([*R.SEVERITIES, "odd", None])) for _ in range(rng.randrange(5))]
        rows.append((i, "".join(rng.choice("äb🙂") for _ in range(n)), spans))
    rows += [(200, None, []), (201, "text", None), (202, "text", [(None, 2, "minor"), (1, None, "major")]), (203, "aa", [(0, 1, "minor"), (1, 2, "minor")])]
    df = spark.createDataFrame(rows, f"id long, t string, error_spans {SPANS}").selectExpr("*", "1 AS at", "2 AS run")
    got = {}
    for r in R.annotated_runs(df, "t", "id").orderBy("start").collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.severity, r.run))
    for i, text, spans in rows:
        marks = [max((R.SEVERITIES.index(s) for a, b, s in spans or [] if s in R.SEVERITIES and (a or 0) <= k < (b or 0)), default=None) for k in range(len(text or ""))]
        want, k = [], 0
        while k < len(marks):
            e = k
            while e < len(marks) and marks[e] == marks[k]:
                e += 1
            want.append((k, e, None if marks[k] is None else R.SEVERITIES[marks[k]], text[k:e]))
            k = e
        assert got.get(i, []) == want, (text, spans)
    assert R.annotated_runs(df.limit(0), "t", "id").count() == 0


def test_lines(spark):
    schema = "id long, de string, ape string, deepl string, triage string, score double, changed boolean, skipped boolean, n_glossary int, error_spans array<struct<text: string, severity: string, confidence: double>>"
    rows = [(1, "Nut", "groove", "slot", "REVIEW", 0.8, True, False, 2, [("gro", "minor", 0.456), ("ve", "major", None)]), (2, None, None, None, None, None, None, None, None, None), (3, "a", "b", "c", "PUBLISH", 0.95, True, True, 0, [])]
    df = spark.createDataFrame(rows, schema)
    got = [(r.id, r.k, r.line) for r in R.report_lines(df, "id").orderBy("id", "k").collect()]
    assert got == [
        (1, 0, "[1] REVIEW (QE: 0.800)  • APE corrected  • 2 errors detected  • 2 glossary terms"), (1, 1, "DE: Nut"), (1, 2, "EN: groove"), (1, 3, "DeepL original: slot"), (1, 4, "QE errors: 'gro' (minor, 0.46), 've' (major, 0.00)"),
        (2, 0, "[2]  (QE: 0.000)"), (2, 1, "DE: "), (2, 2, "EN: "), (3, 0, "[3] PUBLISH (QE: 0.950)  • QE passthrough"), (3, 1, "DE: a"), (3, 2, "EN: b"), (3, 3, "DeepL original: c"),
    ]
    assert R.report_summary(df).head().line == "Processed 3 segments  |  Publish: 1 (33%)  |  Review: 1 (33%)  |  Full Edit: 0 (0%)  |  APE Changed: 2 (66%)  |  QE Passthrough: 1 (33%)  |  Glossary forced: 1"
    assert "Processed 0 segments  |  Publish: 0 (0%)" in R.report_summary(df.limit(0)).head().line


def test_first_of_each(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i) for i in rng.sample(range(10_000), 400)]
    df = spark.createDataFrame(rows, "g string, o long")
    for most in (0, 1, 7, 100, 1000):
        want = sorted((str(g), o) for g in {x for x, _ in rows} for o in sorted(o for x, o in rows if x == g)[:most])
        assert sorted((str(r.g), r.o) for r in C.first_of_each(df, "g", "o", most).collect()) == want
    assert C.first_of_each(df.limit(0), "g", "o", 3).count() == 0


def test_the_cap_comes_after_the_filter(spark, tmp_path):
    def file(name, lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    good = [f"  ein guter Satz {'x' * i}" for i in range(6)]
    left = file("a.de", ["kurz", good[0], "", good[1], good[2], good[3]])
    right = file("a.en", ["short", "a good sentence one", "a good sentence two", "   ", "a good sentence four", "a good sentence five"])
    other = file("b.de", good), file("b.en", [f"another sentence {i}" for i in range(6)])
    got = {(r.corpus, r.line_no): (r.src, r.ref) for r in C.concatenated(spark, {"a": (left, right), "b": other}, 2).collect()}
    assert set(got) == {("a", 1), ("a", 4), ("b", 0), ("b", 1)} and got["a", 1] == ("ein guter Satz", "a good sentence one")
    assert C.concatenated(spark, {"a": (left, right)}, skip=2).count() == 2


def test_runs_without_a_shuffle(spark):
    span = "array<struct<start:int,end:int,severity:string>>"
    rows = [(k, "x" * (k % 7), [(a, a + k % 4, ("minor", "major", "critical", "odd")[(a + k) % 4]) for a in range(-1, k % 9)] if k % 5 else None) for k in range(60)]
    df = R.annotated_runs(spark.createDataFrame(rows, f"k int, t string, error_spans {span}"), "t", "k")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in df.orderBy("k", "start").collect():
        got.setdefault(r.k, []).extend([r.severity] * (r.end - r.start))
        assert r.run == "x" * (r.end - r.start)
    grave = lambda own, i: max((("minor", "major", "critical").index(s) for a, b, s in own or () if s != "odd" and max(a, 0) <= i < b), default=None)
    assert got == {k: [None if (g := grave(own, i)) is None else ("minor", "major", "critical")[g] for i in range(len(t))] for k, t, own in rows if t}


def test_pairs_are_judged_once(spark):
    good = ("Eine Welle dreht sich", "A shaft is turning round")
    rows = [("a", 5, *good), ("a", 5, *good), ("a", 5, "x", "y"), ("a", 9, *good), ("a", 1, "1", "2"), ("a", 2, *good), (None, 3, *good), (None, 8, *good), ("b", 4, "x", "y"), ("a", None, *good)]
    df = spark.createDataFrame(rows, "corpus string, line_no long, src string, ref string")
    kept = lambda most: sorted(((r.corpus or "", r.line_no) for r in C.usable(df, most).collect()))
    assert kept(1) == [("", 3), ("a", 2)] and kept(2) == [("", 3), ("", 8), ("a", 2), ("a", 5)] and kept(9) == [("", 3), ("", 8), ("a", 2), ("a", 5), ("a", 5), ("a", 9)]
    reason = df.select(reject_reason(df.src, df.ref).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert reason.count("(coalesce(src") == reason.count("(coalesce(ref") == 1 and reason.count("regexp_replace") == 1
