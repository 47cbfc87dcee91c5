import re
from collections import Counter, defaultdict

from korpora.llm import source_audit as A

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        found = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        groups.add((lang, source))
        df[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        ps, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pair = {o: sum(f(ps[s][t], ps[o][t]) for t in kept) for o in sources if o != s}
            term = {t: f(ps[s][t], q[t]) for t in kept if counts[lang, s][t] and ps[s][t] > q[t]}
            for part, values, most in (("pair", pair, None), ("term", term, 10)):
                order = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(order)]
    return sorted(out)


def same(df, least=10):
    assert sorted(map(tuple, A.audited(df, least).collect())) == brute(df.collect(), least)


def test_as_brute_force(spark, docs, odd, none):
    same(docs)
    for least in (1, 2, 10):
        same(odd, least)
    assert A.audited(none).count() == 0


def test_nulls_copies_and_ties(spark):
    rows = [(None, None, None), (None, "a", "x"), ("The THE Äpfel äpfel", None, "x"), ("the cat", "a", None), ("the cat", "a", None), ("0 1 2", "a", "empty"), ("b c d", "a", "y"), ("d c b", "a", "z"), ("q", "b", "only"), ("日本 語 the\u0000the", "a", "y")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS n", "2 AS p", "3 AS total", "'x' AS term", "4 AS zero")
    for least in (1, 2):
        same(df, least)


def test_long_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(A, "PART", 7)
    text = "Abc déf, GHI-jkl mno" * 50
    assert [t.decode() for part in A.terms(text.encode()) for t in part] == TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_small_arrow_batches(spark, docs):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        same(docs, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
