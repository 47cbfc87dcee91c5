"""Language-model scores from a lattice of subwords.

The vocabulary of pieces is given; as it has no unigram scores, their probabilities are counted on the learnable texts (each distinct word is segmented once by the
vocabulary's own library and weighted by its count, add-``SMOOTH``). The probability of a text is the sum over all its segmentations: a
forward recursion in log space over the lattice of pieces. Pieces never cross white space, so a text's lattice falls into those of its words, and each distinct word of
the corpus is scored once. A character that no piece holds is spelt in byte pieces. The end of a text is one more piece, counted once a learnable text, so the probabilities of all pieces and
the end sum to one.

Plan: texts are turned into packed batches once (word numbers by document, and the batch's distinct words dealt into buckets by hash). Each bucket sums
its words' counts; totals and piece counts are bounded by the vocabulary; each bucket then scores its words and answers every batch
that asked. A word that fills a third of the corpus is one entry a batch, so no key is hot. All counts cover all learnable texts.

Null text counts as empty: its only token is the end. Null ids are scored, held_out false, and not learned from. Repeated
rows count and are returned each. An empty table gives no rows. Only doc_id and text are read; other columns, clashing names included, are left behind.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.llm.common import buckets, chunks, mapped, pack, raw, remainder, stored, unpack, words

SMOOTH = 0.1
MARK = "▁"
LN10 = math.log(10)
ROWS = "batch long, bucket int, blob binary"


@lru_cache(maxsize=2)
def vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def batched(documents: DataFrame, n_buckets: int, held_out) -> DataFrame:
    """Packed batches: bucket -1 has a batch's documents as word numbers, the others its distinct words with their learnable counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, k = TaskContext.get().partitionId(), 0
        for b in chunks(batches):
            number: dict[bytes, int] = {}
            ids, sizes = [], []
            for text in b.column("text").to_pylist():
                w = words(text, lower=True)
                ids += [number.setdefault(x, len(number)) for x in w]
                sizes.append(len(w))
            ids, sizes = np.array(ids, np.int32), np.array(sizes, np.int32)
            learn = np.array(b.column("learn").to_pylist(), bool)
            count = np.bincount(ids[np.repeat(learn, sizes)], minlength=len(number)).astype(np.int64)
            doc = b.column("doc_id")
            flags = np.array(doc.is_null().to_pylist(), np.uint8) | np.array(b.column("held_out").to_pylist(), np.uint8) << 1
            out = [(-1, pack(doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), flags, sizes, ids))]
            every = list(number)
            place = np.fromiter((zlib.crc32(x) % n_buckets for x in every), np.int32, len(every))
            order = np.argsort(place, kind="stable").astype(np.int32)
            ends = np.searchsorted(place[order], np.arange(n_buckets + 1))
            for j in np.unique(place).tolist():
                own = order[ends[j] : ends[j + 1]]
                out.append((j, pack(b" ".join([every[i] for i in own.tolist()]), own, count[own])))
            yield {"batch": [part << 32 | k] * len(out), "bucket": [x for x, _ in out], "blob": [x for _, x in out]}
            k += 1

    rows = raw(documents, F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(~held_out, F.lit(False)).alias("learn"))
    return mapped(rows, work, ROWS)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    """Rows (batch, bucket, blob) by runs of equal ``key``; streamed."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("batch", "bucket", "blob")), strict=True))
    return groupby(rows, key=lambda r: r[0 if key == "batch" else 1])


def counted(packed: DataFrame) -> DataFrame:
    """One row a bucket (batch -1): its distinct words and their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for bucket, rows in runs(batches, "bucket"):
            total: dict[bytes, int] = {}
            for _, _, blob in rows:
                text, _, count = unpack(blob, None, np.int32, np.int64)
                for w, c in zip(text.split(), count.tolist(), strict=True):
                    total[w] = total.get(w, 0) + c
            yield {"batch": [-1], "bucket": [bucket], "blob": [pack(b" ".join(total), np.array(list(total.values()), np.int64))]}

    return mapped(packed.filter("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket"), work, ROWS)


def piece_counts(counts: DataFrame, path: str) -> dict[int, int]:
    """Piece counts over the distinct words; -1: tokens, -2: distinct words that occur. As many rows as the vocabulary has pieces, at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sp = vocabulary(path)
        total = np.zeros(sp.get_piece_size(), np.int64)
        n = v = 0
        for _, rows in runs(batches, "bucket"):
            for _, _, blob in rows:
                text, count = unpack(blob, None, np.int64)
                known = [(w.decode("utf-8", "replace"), c) for w, c in zip(text.split(), count.tolist(), strict=True) if c]
                n, v = n + int(count.sum()), v + len(known)
                for at in range(0, len(known), 4096):
                    part = known[at : at + 4096]
                    ids = sp.encode([w for w, _ in part], num_threads=1)
                    total += np.bincount(np.concatenate([np.array(i, np.int64) for i in ids]), np.repeat([c for _, c in part], [len(i) for i in ids]), len(total)).astype(np.int64)
        own = np.flatnonzero(total)
        yield {"piece": [-1, -2, *own.tolist()], "n": [n, v, *total[own].tolist()]}

    return {r.piece: r.n for r in mapped(counts, work, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}


class Lattice:
    """Forward recursion over all segmentations into pieces, in natural logarithms."""

    def __init__(self, pieces: dict[str, float], bytes_: list[float]):
        self.edges: dict[str, float | None] = {}
        for p, v in pieces.items():
            for k in range(1, len(p)):
                self.edges.setdefault(p[:k], None)
            self.edges[p] = v
        self.bytes = bytes_

    def word(self, text: str) -> float:
        s = MARK + text
        n = len(s)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        edges, gone = self.edges, object()
        at = 0.0
        for i in range(n):
            if i:
                terms = into[i]
                if not terms:
                    continue
                top = max(terms)
                at = top if len(terms) == 1 else top + math.log(sum(math.exp(t - top) for t in terms))
                into[i] = []
            j = i + 1
            while j <= n and (v := edges.get(s[i:j], gone)) is not gone:
                if v is not None:
                    into[j].append(at + v)
                j += 1
            if edges.get(s[i]) is None:
                into[i + 1].append(at + sum(self.bytes[b] for b in s[i].encode("utf-8", "replace")))
        top = max(into[n])
        return top + math.log(sum(math.exp(t - top) for t in into[n]))


def lattice(path: str, counts: dict[int, int], ends: int) -> tuple[Lattice, float]:
    """The lattice of the vocabulary under these piece counts, and the logarithm of the probability of an end after ``ends`` of them."""
    sp = vocabulary(path)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    whole = sum(counts.get(i, 0) for i in usable) + ends + SMOOTH * (len(usable) + 1)
    log = lambda n: math.log((n + SMOOTH) / whole)
    plain = {sp.id_to_piece(i): log(counts.get(i, 0)) for i in usable if not sp.is_byte(i)}
    spelt = {int(sp.id_to_piece(i)[3:5], 16): log(counts.get(i, 0)) for i in usable if sp.is_byte(i)}
    return Lattice(plain, [spelt.get(b, math.log(SMOOTH / whole)) for b in range(256)]), log(ends)


def scored(documents: DataFrame, path: str, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; learns from those not held out."""
    n_buckets = buckets(documents.sparkSession)
    packed = stored(batched(documents, n_buckets, held_out), "lm-batches")
    counts = stored(counted(packed), "lm-words")
    total = piece_counts(counts, path)
    ends = documents.filter(~held_out).count()
    tokens, known_words = total.pop(-1, 0) + ends, total.pop(-2, 0)
    distinct = known_words + (ends > 0)
    below = math.log10(tokens + 0.5 * (distinct + 1))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model, _ = lattice(path, total, ends)
        for bucket, rows in runs(batches, "bucket"):
            number: dict[bytes, int] = {}
            for batch, _, blob in rows:
                if batch < 0:
                    text, count = unpack(blob, None, np.int64)
                    every = text.split()
                    number = {w: i for i, w in enumerate(every)}
                    score = np.array([model.word(w.decode("utf-8", "replace")) for w in every]) / LN10
                    continue
                text, own, _ = unpack(blob, None, np.int32, np.int64)
                at = np.fromiter(map(number.__getitem__, text.split()), np.int64, len(own))
                yield {"batch": [batch], "bucket": [bucket], "blob": [pack(own, count[at], score[at])]}

    asked = packed.filter("bucket >= 0").unionAll(counts).repartition("bucket").sortWithinPartitions("bucket", "batch")
    replies = mapped(asked, answers, ROWS).unionAll(packed.filter("bucket < 0")).repartition("batch").sortWithinPartitions("batch", "bucket")
    end_base = math.log10(ends + 0.5) - below
    end_score = lattice(path, total, ends)[1] / LN10

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, rows in runs(batches, "batch"):
            ids = doc = None
            for _, bucket, blob in rows:
                if bucket < 0:
                    doc, flags, sizes, ids = unpack(blob, np.int64, np.uint8, np.int32, np.int32)
                    n = int(ids.max(initial=-1)) + 1
                    count, score = np.zeros(n, np.int64), np.zeros(n)
                else:
                    own, c, s = unpack(blob, np.int32, np.int64, np.float64)
                    count[own], score[own] = c, s
            owner = np.repeat(np.arange(len(doc)), sizes)
            base = np.log10(count + 0.5) - below
            add = lambda x: np.bincount(owner, x[ids], len(doc))
            yield {
                "doc_id": pa.array(doc, pa.int64(), mask=(flags & 1).astype(bool)),
                "held_out": pa.array((flags & 2).astype(bool)),
                "n_tokens": sizes.astype(np.int64) + 1,
                "n_known": add((count > 0).astype(float)).astype(np.int64) + (ends > 0),
                "train_tokens": np.full(len(doc), tokens, np.int64),
                "base_score": add(base) + end_base,
                "score": add(score) + end_score,
            }

    return mapped(replies, finished, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
