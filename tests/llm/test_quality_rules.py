import re
from collections import Counter

from korpora.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, docs, odd, none):
    for df in (docs, odd, none):
        got = Q.judge(df).select("doc_id", *Q.MEASURES[:5]).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((r.doc_id, *brute(r.text))) for r in df.collect())


def test_policies_and_ablation(docs):
    entries = Q.ledger(docs, "doc_id").cache()
    assert Q.apply_policy(entries, 1).filter("kept").count() >= Q.apply_policy(entries, 2).filter("kept").count() > 0
    bits = [r.fail_bits for r in entries.collect()]
    for row in Q.ablation(entries, 2).collect():
        b = 1 << next(r.bit for r in Q.RULES if r.name == row.rule)
        assert (row.rejected, row.rejected_alone) == (sum(x & b > 0 for x in bits), sum(x == b for x in bits))


def test_good_documents_stay(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = Q.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id")
    good = judged.filter("quality = 1 AND NOT base_failed")
    assert good.filter("kept").count() >= 0.98 * good.count()
    bad = judged.filter("quality = 0")
    assert bad.filter("NOT kept").count() >= 0.8 * bad.count()
