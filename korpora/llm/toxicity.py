"""Toxicity: subword-bag embeddings averaged into a linear softmax.

Words are lower-cased and framed by spaces; their byte n-grams (3 to 6, hashed to ``BUCKETS`` rows) form the bag of a passage of ``PASSAGE`` words, each word once. A passage's
vector is the mean of its grams' embeddings; a linear softmax over two classes sits on it. Embeddings and softmax are
trained jointly in numpy with Adagrad. A document is as toxic as its most toxic passage, so one insult counts in a long text, and training works on that
passage: each epoch takes the passage that the model finds most toxic, of toxic documents as a positive and of others as a negative.
A misspelt insult shares most grams with its known spelling. The threshold is put between the two classes on a part of the learnable
rows kept back for it.

For scoring, the softmax is multiplied into the embeddings once, which leaves one number a gram; the result is the same and a text costs one gather.

Learning takes at most ``per_class`` labelled rows of each class, of at most ``longest`` bytes, by hash order of the id: a documented bound. Scores read whole texts. Null and empty
texts get the score of an empty bag (the bias). Without a learnable row of both classes every score is 0. Null ids are scored, held_out false, and never learned from. Repeated rows give a row each.
An empty table gives no rows; other columns, clashing names included, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.llm.common import chunks, mapped, raw, remainder

SIZES = (3, 4, 5, 6)
BITS = 18
BUCKETS = 1 << BITS
PASSAGE = 4
#: Passages of a toxic text that are taken as positives, the second with half the weight of the first.
TOP = 2
#: Grams of fewer texts stay zero: they would only tell single texts apart.
SEEN = 4
#: A smaller bag is averaged as if it had so many grams, so that a short passage isn't judged by one of them.
LEAST = 60
DIM = 8
MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of all grams, the passage of each, the number of passages."""
    words = text.decode("utf-8", "replace").lower().encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), 0
    bags = [list(dict.fromkeys(words[i : i + PASSAGE])) for i in range(0, len(words), PASSAGE)]
    passage = np.repeat(np.arange(len(bags), dtype=np.int32), [len(x) for x in bags])
    b = np.frombuffer(b" " + b" ".join(chain.from_iterable(bags)) + b" ", np.uint8)
    space = b == 32
    word = np.cumsum(space) - 1  # of the gram that starts here
    inner = ~space
    ids, owners = [], []
    h = b.astype(np.uint64)
    clear = np.ones(len(b), bool)  # no space inside, the ends excluded
    for n in range(2, SIZES[-1] + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint64(0x100000001B3) + b[n - 1 :]
        clear = clear[: len(b) - n + 1]
        if n > 2:
            clear = clear & inner[n - 2 : len(b) - 1]
        if n in SIZES:
            at = np.flatnonzero(clear)
            ids.append(((h[at] * MIX) >> np.uint64(64 - BITS)).astype(np.int32))
            owners.append(passage[word[at]])
    return np.concatenate(ids), np.concatenate(owners), len(bags)


@dataclass
class Model:
    gram: np.ndarray  # embeddings times the softmax's difference
    bias: float

    def logits(self, text: bytes) -> float:
        i, p, n = grams(text)
        if not n:
            return self.bias
        total, count = np.bincount(p, self.gram[i], n), np.bincount(p, minlength=n)
        return float((total / np.maximum(count, LEAST)).max() + self.bias)


def fit(texts: list[bytes], toxic: list[int], epochs: int = 12, rate: float = 0.5, seed: int = 5) -> Model:
    """Joint training of embeddings and softmax; every fourth text is kept back for the threshold."""
    rng = np.random.default_rng(seed)
    bags = []
    for t in texts:
        i, p, n = grams(t)
        o = np.argsort(p, kind="stable")
        bags.append((i[o], np.concatenate([[0], np.cumsum(np.bincount(p, minlength=n))]).astype(np.int64) if n else np.zeros(1, np.int64)))
    y = np.array(toxic)
    back = np.arange(len(texts)) % 4 == 3
    train = [k for k in range(len(texts)) if not back[k] and len(bags[k][1]) > 1]
    held_by = np.zeros(BUCKETS, np.int32)
    for k in train:
        held_by[np.unique(bags[k][0])] += 1
    common = held_by >= SEEN
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32) * common[:, None]
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_soft, g_bias = np.full(BUCKETS, 1e-4, np.float32), np.full(soft.shape, 1e-4, np.float32), np.full(2, 1e-4, np.float32)

    def means(k: int, score: np.ndarray) -> np.ndarray:
        i, ends = bags[k]
        sums = np.concatenate([[0.0], np.cumsum(score[i], dtype=np.float64)])
        return (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(np.diff(ends), LEAST)

    for epoch in range(epochs):
        score = emb @ (soft[:, 1] - soft[:, 0])
        picks = []
        for k in train:
            n = len(bags[k][1]) - 1
            best = rng.integers(n) if epoch == 0 and not y[k] else int(np.argmax(means(k, score)))
            if epoch == 0 and y[k]:
                picks += [(k, j, 1, 1 / min(n, 30)) for j in rng.permutation(n)[:30]]
            else:
                top = np.argsort(-means(k, score))[: TOP if y[k] else 1] if epoch else [best]
                picks += [(k, int(j), int(y[k]), 1 / (1 + r)) for r, j in enumerate(top)]
            if not y[k]:
                picks += [(k, int(j), 0, 1.0) for j in rng.integers(n, size=3)]
        weight = {c: sum(w for *_, z, w in picks if z == c) or 1.0 for c in (0, 1)}
        rng.shuffle(picks)
        for at in range(0, len(picks), 128):
            part = picks[at : at + 128]
            rows = [bags[int(k)][0][bags[int(k)][1][int(j)] : bags[int(k)][1][int(j) + 1]] for k, j, _, _ in part]
            size = np.array([len(r) for r in rows])
            ids, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
            vec = np.stack([np.bincount(owner, emb[ids, d], len(rows)) for d in range(DIM)], 1) / np.maximum(size, LEAST)[:, None]
            z = vec @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            c = np.array([int(x[2]) for x in part])
            w = np.array([x[3] * len(picks) / (2 * weight[int(x[2])]) for x in part])
            err = (p - np.eye(2)[c]) * w[:, None] / len(part)
            back_vec = (err @ soft.T) / np.maximum(size, LEAST)[:, None]
            gs, gb = vec.T @ err, err.sum(0)
            g_soft += gs**2
            soft -= rate * gs / np.sqrt(g_soft)
            g_bias += gb**2
            bias -= rate * gb / np.sqrt(g_bias)
            used, local = np.unique(ids, return_inverse=True)
            ge = np.stack([np.bincount(local, back_vec[owner, d], len(used)) for d in range(DIM)], 1)
            g_emb[used] += (ge**2).mean(1)
            emb[used] -= (rate * ge / np.sqrt(g_emb[used])[:, None] * common[used, None]).astype(np.float32)
    model = Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    held = [(model.logits(texts[k]), int(y[k])) for k in range(len(texts)) if back[k]]
    model.bias -= cut(held)
    return model


def cut(held: list[tuple[float, int]]) -> float:
    """The threshold with the fewest errors on texts kept back, a clean one flagged counting twice; midway between its neighbours."""
    if len({y for _, y in held}) < 2:
        return 0.0
    held = sorted(held)
    cost = sum(2 for _, y in held if not y)
    best, at = cost, held[0][0] - 1.0
    for k, (z, y) in enumerate(held):
        cost += 1 if y else -2
        if cost < best:
            best, at = cost, (z + held[k + 1][0]) / 2 if k + 1 < len(held) else z + 1.0
    return at


def learned(documents: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 8_000) -> Model | None:
    """The model of labelled rows whose id's remainder by 5 is not 0."""
    own = labels.select(F.col("doc_id").cast("long"), "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    order = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 40))
    share = F.when(F.col("toxic") == 1, min(1.0, (1.3 * per_class + 50) / counts[1])).otherwise(min(1.0, (1.3 * per_class + 50) / counts[0]))
    # about 2.6 * per_class rows by the shares above; the limit only proves the bound of what is broadcast
    some = own.filter(order < share * (1 << 40)).withColumn("o", order).limit(4 * per_class)
    rows = raw(documents).filter(F.octet_length("text") <= longest).join(F.broadcast(some), "doc_id").select("o", "toxic", "text").collect()
    by: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: (r.o, bytes(r.text))):
        if len(by[r.toxic]) < per_class:
            by[r.toxic].append(bytes(r.text))
    pairs = [(t, c) for c in by for t in by[c]]
    return fit([t for t, _ in pairs], [c for _, c in pairs]) if by[0] and by[1] else None


def scored(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in chunks(batches):
            z = np.array([model.logits(t or b"") if model else -np.inf for t in batch.column("text").to_pylist()])
            yield {"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(z, -500, 500))) if model else np.zeros(len(z))}

    return mapped(raw(documents), work, "doc_id long, score double")


def predicted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = scored(documents, learned(documents, labels))
    return rows.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
