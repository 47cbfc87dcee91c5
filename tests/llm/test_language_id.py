import numpy as np

from korpora.llm import language_id as L


def test_held_out_accuracy(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang_pred <> 'und'").collect()
    assert len(rows) > 250 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    model = L.learned(docs)
    out = L.identify(odd, model).collect()
    assert len(out) == odd.count()
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    assert L.identify(none, model).count() == 0
    assert {r.lang_pred for r in L.predicted(odd.filter("lang IS NULL")).collect()} == {"und"}


def test_collapsed_weights_are_the_kernel_machine():
    texts = ["das ist ein haus", "the house is big", "la casa es grande", "der hund und die katze", "a dog and the cat", "el perro y la gata"]
    points = [L.presence(t) for t in texts]
    k = L.kernel(points, points)
    assert np.allclose(np.diag(k), 1) and np.allclose(k, k.T)
    model = L.fit(texts, ["de", "en", "es"] * 2, landmarks=6)
    y = np.where(np.array(["de", "en", "es"] * 2)[:, None] == np.array(model.languages), 1.0, -1.0)
    assert np.allclose(k @ np.linalg.solve(k + 0.05 * np.eye(6), y), model.scores(texts), atol=1e-4)


def test_predictions_are_those_of_the_kernel_machine(spark, docs, none):
    """Brute force: kernel values from Python sets, the ridge regression on Nystroem features, every text against every landmark."""

    def places(text):
        out = set()
        t = text.lower()
        for n in range(1, L.MAX_N + 1):
            for i in range(len(t) - n + 1):
                g = 0
                for m, c in enumerate(t[i : i + n], 1):
                    g = (g * int(L.FACTORS[3]) + (ord(c) + m) * int(L.FACTORS[0])) % 2**64
                out.add((g ^ g >> 29) * int(L.FACTORS[1]) % 2**64 >> 49)
        return out

    pairs = sorted(L.sample(docs))[::6]
    texts, langs = [t for t, _ in pairs], [k for _, k in pairs]
    names = sorted(set(langs))
    model = L.fit(texts, langs, landmarks=20)
    seen = {k: 0 for k in names}
    turn = []
    for i, k in enumerate(langs):
        turn.append((seen[k], k, i))
        seen[k] += 1
    sets = [places(t) for t in texts]
    marks = [sets[i] for _, _, i in sorted(turn)[:20]]
    value = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    gram = np.array([[value(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(gram)
    root = vectors / np.sqrt(values)
    features = np.array([[value(a, b) for b in marks] for a in sets]) @ root
    y = np.array([[1.0 if k == n else -1.0 for n in names] for k in langs])
    solved = root @ np.linalg.solve(features.T @ features + 0.05 * np.eye(20), features.T @ y)
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    for d in sorted(rows)[::7]:
        if got[d].lang_pred != L.UNKNOWN:
            f = np.array([value(places(rows[d]), b) for b in marks]) @ solved
            assert abs(got[d].score - min(1, max(0, (1 + f.max()) / 2))) < 1e-3
            assert got[d].lang_pred == names[f.argmax()] or np.sort(f)[-1] - np.sort(f)[-2] < 1e-3
    assert L.predicted(none).count() == 0
