"""Queries without SQL give a row for all of their input."""

from korpora.plans import catalog
from korpora.plans import views as V

DIR = "/root/testdata/sf0.001"


def test_numbered_answers_hold_every_sentence(spark):
    want = {(r.doc_id, r.idx): r.sentence.strip() for r in V.sentences(spark, DIR).collect()}
    most = {}
    for d, _ in want:
        most[d] = most.get(d, 0) + 1
    got = {(r.doc_id, r.local): r.text for r in catalog.queries()["numbered_answers"](spark, DIR).collect()}
    assert max(most.values()) > 8
    assert set(got) == set(want) | {(d, n) for d, n in most.items()}  # one more than there are is expected, and padded
    assert all(got[k] == v for k, v in want.items() if most[k[0]] >= 4)  # with fewer the padding makes the parser fall back to lines


def test_metrics_score_every_pair(spark, tmp_path):
    turns = ["the cat of the house and the dog", "a b of c and d. " * 40, "word of another and more. " * 90]
    rows = [(c, t, r, x) for c, x in enumerate(turns) for t, r in enumerate(("user", "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    q = catalog.queries()
    for name in ("edit_types", "diff_ratio", "word_edit_distance"):
        got = {r.id // 1000: r for r in q[name](spark, str(tmp_path)).collect()}
        assert set(got) == {0, 1, 2}
    assert [got[k].ter for k in (0, 1, 2)] == [2 / 8, 2 / 6, 2 / 5]


def test_report_rows_hold_whole_texts(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(len("EN: ") + len(r.text.lower() if r.doc_id % 6 == 0 and r.doc_id % 12 else r.text) for r in rows)
    assert sorted(r.chars for r in catalog.queries()["report_rows"](spark, DIR).collect()) == want
