import math

from korpora.llm import toxicity as T


def test_held_out(spark, odd, none):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = T.predicted(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    recall, precision = hit / sum(r.toxic for r in rows), hit / max(1, sum(r.predicted for r in rows))
    print(recall, precision)
    assert recall > 0.8 and precision > 0.85  # of some labelled texts nothing toxic is left
    out = T.predicted(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert T.predicted(none, labels).count() == 0


def test_scores_are_the_worst_passages_mean(spark, docs, odd):
    """Brute force: n-grams of every word of every passage by plain loops, against the model's embeddings."""
    d = "/root/testdata/sf0.01"
    model = T.learned(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    cache = {}

    def gram(g):
        if g not in cache:
            h = g[0]
            for b in g[1:]:
                h = (h * 0x100000001B3 + b) % 2**64
            cache[g] = float(model.gram[(h * int(T.MIX)) % 2**64 >> 64 - T.BITS])
        return cache[g]

    def logit(text):
        words = text.lower().encode().split()
        best = None
        for i in range(0, len(words), T.PASSAGE):
            own = [f for w in dict.fromkeys(words[i : i + T.PASSAGE]) for f in [b" " + w + b" "]]
            grams = [f[a : a + n] for f in own for n in T.SIZES for a in range(len(f) - n + 1)]
            mean = sum(map(gram, grams)) / max(len(grams), T.LEAST)
            best = mean if best is None else max(best, mean)
        return model.bias + (best or 0.0)

    for df in (docs, odd):
        got = T.scored(df, model).collect()
        want = sorted((str(r.doc_id), logit(r.text or "")) for r in df.collect())
        have = sorted((str(r.doc_id), r.score) for r in got)
        assert all(a == b and abs(1 / (1 + math.exp(-z)) - s) < 1e-4 for (a, z), (b, s) in zip(want, have, strict=True))


def test_one_class_only(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = T.predicted(docs, labels).collect()
    assert len(rows) == docs.count() and {(r.score, r.predicted) for r in rows} == {(0.0, 0)}
