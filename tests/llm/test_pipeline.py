import corpus_pipeline as C
from tests.llm import test_decontamination, test_jaccard_join, test_quality_rules, test_substring_dedup  # noqa: F401

DIR = "/root/testdata/sf0.001"


def test_stages_keep_what_brute_force_keeps(spark, docs):
    columns = docs.columns
    good = C.good(spark, docs, DIR)
    rows = {r.doc_id: r.text for r in good.collect()}
    measures = {r.doc_id: test_quality_rules.brute(r.text) for r in docs.collect()}
    assert all(m[0] >= 50 and 100 * m[4] <= 50 * m[0] for d, m in measures.items() if d in rows)
    near = C.one_of_each(spark, good, DIR)
    want = {d for d in rows if any(x.startswith(f"({d}, ") and x.endswith(f", {d})") for x in test_jaccard_join.brute(list(rows.items()), 5, 80))}
    assert {r.doc_id for r in near.collect()} == want
    cut = C.without_repeats(spark, near, DIR)
    kept = {r.doc_id: r.text for r in cut.collect()}
    lengths = {x.split(", ")[0][1:]: x for x in test_substring_dedup.brute([(r.doc_id, r.text) for r in near.collect()], 20)}
    for d, t in kept.items():
        _, n, gone, _ = lengths[str(d)].split(", ")
        assert len(t.encode().split()) == int(n) - int(gone)
    clean = C.uncontaminated(spark, cut, DIR)
    assert clean.columns == cut.columns == near.columns == good.columns == columns
    final = C.sequences(spark, clean, DIR).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in clean.collect()}


def test_odd_rows(spark, odd, none):
    for df in (odd, none):
        for _, stage in C.STAGES:
            df = stage(spark, df, DIR).cache()
            df.count()


def test_run(spark):
    assert C.run(spark, DIR).count() > 100


def test_long_clean_documents_stay(spark):
    text = "\n".join(" ".join(f"word{i}x{j}" for j in range(10)) for i in range(10_001))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(text.split()) > 100_000
    assert [r.text for r in C.good(spark, docs, DIR).collect()] == [text]
