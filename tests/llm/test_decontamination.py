import math
import random
import re
import string

import numpy as np
from pyspark.sql import functions as F

from korpora.llm import decontamination as D


def test_wand_is_exhaustive_search():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab[: 10 + i % 50]) for _ in range(r.randrange(3, 20))).encode()) for i in range(150)]
    idx = D.index(items, 3)
    for _ in range(200):
        terms = [idx.number[w.encode()] for w in r.sample(vocab, 25) if w.encode() in idx.number]
        score = np.zeros(150)
        for t in terms:
            score[idx.items[t]] += idx.impacts[t]
        for limit in (0.4, 0.5, 0.9):
            if (score >= limit).any():
                assert idx.hopeful(np.array(terms), np.full(len(terms), 4), limit).tolist() == [4, 5]
            got = idx.retrieve(terms, limit)
            assert sorted(k for k, _ in got) == np.flatnonzero(score >= limit).tolist() or np.isclose(score, limit).any()


def test_planted_and_clean(spark, docs, odd, none):
    d = "/root/testdata/sf0.01"
    documents, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    items = [(r.item_id, D.terms_of(r.text.encode())) for r in bench.collect()]
    got = {r.doc_id: set(r.items) for r in D.matches(documents, bench).collect()}
    for r in documents.collect():
        w = D.terms_of(r.text.encode())
        g = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        share = {k: np.mean([tuple(x[i : i + 3]) in g for i in range(len(x) - 2)]) for k, x in items}
        assert {k for k, v in share.items() if v == 1} <= got[r.doc_id]
        assert all(share[k] > 0.5 for k in got[r.doc_id])
    text = bench.filter("item_id = 3").collect()[0].text
    far = "x y z " * 8000
    extra = spark.createDataFrame([(1, far + text.upper() + " " + far), (2, text), (4, far + text.translate(str.maketrans("", "", ".,!?;:")) + far), (3, " ".join(text.split()[: len(text.split()) // 3]))], "doc_id long, text string")
    assert {r.doc_id: r.contaminated for r in D.matches(extra, bench).collect()} == {1: True, 2: True, 4: True, 3: False}
    for df in (odd, none):
        rows = D.matches(df, bench).collect()
        assert len(rows) == df.count() and not any(r.contaminated for r in rows)
    assert D.matches(documents, bench.limit(0)).filter("contaminated").count() == 0


def test_shards_find_what_one_index_finds(spark, odd, monkeypatch):
    d = "/root/testdata/sf0.001"
    documents, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    bench = bench.unionByName(bench.limit(3).selectExpr("CAST(NULL AS long) AS item_id", "text"), allowMissingColumns=True).select("item_id", "text")
    rows = odd.select("doc_id", "text", "lang").unionByName(documents.select("doc_id", "text", "lang"))
    held = bench.selectExpr("CAST(NULL AS long) AS doc_id", "text", "'en' AS lang")
    rows = rows.unionByName(held).unionByName(held.groupBy("doc_id", "lang").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text")))
    whole = D.matches(rows, bench, keep=("text", "lang"))
    want = sorted(map(str, whole.collect()))
    monkeypatch.setattr(D, "MAX_ITEMS", 15)
    parts = D.matches(rows, bench, keep=("text", "lang"))
    assert bench.count() > 2 * 15 and parts.columns == whole.columns
    assert sum("contaminated=True" in x for x in want) > 40 and sorted(map(str, parts.collect())) == want


def test_items_are_those_of_an_exhaustive_search(spark, odd):
    """Brute force: BM25 of every passage with every item from plain counts, then the grams of question and answer around it."""
    d = "/root/testdata/sf0.001"
    documents, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    table = str.maketrans({c: " " for c in string.punctuation} | {c: c.lower() for c in string.ascii_uppercase})
    split = lambda t: re.split("[\x09-\x0D ]+", t.translate(table).strip("\x09\x0a\x0b\x0c\x0d ")) if t and t.translate(table).strip("\x09\x0a\x0b\x0c\x0d ") else []
    items = {r.item_id: r.text for r in bench.collect() if split(r.text)}
    own = {i: split(t) for i, t in items.items()}
    mean = sum(map(len, own.values())) / len(own)
    holding = {w: sum(w in set(x) for x in own.values()) for x in own.values() for w in x}
    impact = {}
    for i, w in own.items():
        raw = {x: math.log(1 + (len(own) - holding[x] + 0.5) / (holding[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(w)}
        impact[i] = {x: v / sum(raw.values()) for x, v in raw.items()}
    size = max(64, max(map(len, own.values())))
    half = size // 2

    def parts(t):
        sentences = [x for x in re.findall(r"[^.!?]+[.!?]*", t.replace("\r", "")) if split(x)]
        return ["".join(sentences[:-1]), sentences[-1]] if len(sentences) > 1 else [t]

    def holds(text, part):
        p = split(part)
        n = min(3, len(p))
        need = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)}
        return len(need & {tuple(text[i : i + n]) for i in range(len(text) - n + 1)}) >= 0.7 * len(need)

    want = {}
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for doc, text in rows:
        w, hit = split(text), set()
        for p in range(-1, len(w) // half + 1):
            a, z = max(0, p * half), min(len(w), p * half + size)
            terms = set(w[a:z])
            for i, v in impact.items():
                if i not in hit and sum(x for t, x in v.items() if t in terms) >= 0.4:
                    ways = parts(items[i])
                    room = size + sum(max(1, len(split(x)) - 2) for x in ways)
                    around = w[max(0, a - room) : z + room]
                    if all(holds(around, x) for x in ways):
                        hit.add(i)
        want[doc] = sorted(hit)
    got = {r.doc_id: sorted(r["items"]) for r in D.matches(documents, bench).collect()}
    assert got == want and sum(map(bool, want.values())) >= 3
