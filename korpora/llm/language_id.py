"""Language identification with string kernels.

The kernel is the blended-spectrum presence kernel: of two texts, the number of distinct n-grams (1 to ``MAX_N``
code points, lower case) that both hold, over the square root of the product of their numbers. Grams are hashed to ``DIMS`` places. Nyström: the kernel is
restricted to a set of landmark texts, K(x, L) K(L, L)^-1/2, and one-versus-rest kernel ridge regression (targets 1 and -1) is solved on these features. For
scoring, the landmark block and the regression weights are multiplied together once: f(x) = presence(x) (P_L A) / |x|, so
``BATCH`` texts at a time are scored by one matrix product of their presence rows and these weights, whose size follows neither the landmarks nor the corpus.

Fitting takes at most ``per_language`` texts of each language (by hash order of the id, of at most ``longest`` bytes), a documented bound. Prediction reads
whole texts. A text that is null or has no letter is ``und`` with score 0, and so is every text if there is nothing to learn
from. Null ids get a prediction and held_out false and are not learned from. Repeated rows give a row each, an empty table none. Only doc_id, text and, for learning, lang are read;
other columns, clashing names included, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.llm.common import chunks, mapped, raw, remainder

MAX_N = 3
#: Texts of a matrix product.
BATCH = 64
DIMS = 1 << 15
UNKNOWN = "und"
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def presence(text: str) -> np.ndarray:
    """Sorted places of the distinct n-grams of the whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    seen = np.zeros(DIMS, bool)
    gram = np.zeros(len(points), np.uint64)
    for n in range(1, MAX_N + 1):
        if len(points) < n:
            break
        gram = gram[: len(points) - n + 1] * FACTORS[3] + (points[n - 1 :] + np.uint64(n)) * FACTORS[0]
        seen[((gram ^ (gram >> np.uint64(29))) * FACTORS[1]) >> np.uint64(49)] = True
    return np.flatnonzero(seen)


def presence_rows(points: list[np.ndarray]) -> np.ndarray:
    """A matrix with a row for each text: 1 over the root of the number of its n-grams at their places, else 0."""
    out = np.zeros((len(points), DIMS), np.float32)
    for row, p in zip(out, points, strict=True):
        row[p] = 1 / max(len(p), 1) ** 0.5
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIMS x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row of regression values for each text: presence rows times the weights, a batch at a time."""
        parts = [presence_rows([presence(t) for t in texts[a : a + BATCH]]) @ self.weights for a in range(0, len(texts), BATCH)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)


def kernel(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Normalised presence kernel of two lists of texts, as products of presence matrices."""
    right = presence_rows(b).T
    return np.concatenate([presence_rows(a[i : i + BATCH]) @ right for i in range(0, len(a), BATCH)]).astype(np.float64)


def fit(texts: list[str], languages: list[str], landmarks: int = 160, ridge: float = 0.05) -> Model:
    names = sorted(set(languages))
    points = [presence(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: (sum(languages[j] == languages[i] for j in range(i)), languages[i]))
    marks = [points[i] for i in order[:landmarks]]
    among = kernel(marks, marks)
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * max(values.max(initial=0), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel(points, marks) @ root
    targets = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ targets)
    by_mark = root @ solved
    weights = np.zeros((DIMS, len(names)))
    for p, w in zip(marks, by_mark, strict=True):
        weights[p] += w / max(len(p), 1) ** 0.5
    return Model(names, weights.astype(np.float32))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def sample(documents: DataFrame, per_language: int = 300, longest: int = 20_000) -> list[tuple[str, str]]:
    """(text, language) of the rows that are learned from; lang is read here only, as the target."""
    rows = documents.select(F.col("doc_id").cast("long"), "text", "lang").filter(F.col("lang").isNotNull() & (remainder(3) != 1) & (F.octet_length("text") <= longest) & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    order = F.xxhash64("doc_id", F.lit("language"))
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2 * per_language / n + 20 / n)))]), F.col("lang"))
    near = rows.filter(F.pmod(order, F.lit(1 << 40)) < share * (1 << 40)).withColumn("o", order)
    by = {}
    for r in sorted(near.select("o", "lang", "text").toLocalIterator(), key=lambda r: (r.o, r.text)):
        if len(by.setdefault(r.lang, [])) < per_language:
            by[r.lang].append(r.text)
    return [(t, k) for k in sorted(by) for t in by[k]]


def learned(documents: DataFrame) -> Model | None:
    """The model of the rows that may be learned from."""
    pairs = sample(documents)
    return fit([t for t, _ in pairs], [k for _, k in pairs]) if pairs else None


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in chunks(batches):
            texts = [(x or b"").decode("utf-8", "replace") for x in batch.column("text").to_pylist()]
            known = [model is not None and has_letter(t) for t in texts]
            names, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if any(known):
                f = model.scores([t for t, k in zip(texts, known, strict=True) if k])
                best = iter(zip(f.argmax(1), f.max(1), strict=True))
                for i in np.flatnonzero(known):
                    c, v = next(best)
                    names[i], score[i] = model.languages[c], float(min(1.0, max(0.0, (1 + v) / 2)))
            yield {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": score}

    return mapped(raw(documents), work, "doc_id long, lang_pred string, score double")


def predicted(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return identify(documents, learned(documents)).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
