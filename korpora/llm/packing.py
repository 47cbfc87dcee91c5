"""Best-fit packing by exact-complement hashing.

Texts become token ids (and an end id); those longer than a sequence are cut into pieces. What a sequence can hold depends on lengths
only, so the plan is made on the histogram of lengths, which has at most ``capacity`` entries whatever the corpus. From
the longest length down, the gap that a piece leaves is looked up among the available single lengths, then among sums of pairs, then of
triples; a combination that fills it exactly is taken as often as the counts allow. Where none fits, the longest length that fits is put in and the new gap
looked up again (best fit). Every piece gets a rank among the pieces of its length (its rank in its task plus the number in tasks before), and the plan is a list
of runs of ranks, so a length that a third of all pieces have is spread over the tasks.

Tokens: words apart by white space are encoded on their own, which gives the ids of the whole text, since the tokenizer drops white space and
nothing it does reaches across it; words are encoded once a worker, as long as it remembers them. Null and wordless texts are one piece, the end id alone. Null ids and repeated rows are packed each.
An empty table gives no rows; other columns, clashing names included, are left behind.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpora.llm.common import chunks, mapped, raw, stored, words
from korpora.llm.token_counts import tokenizer

#: Stands between words that are encoded together; as a word it is one token.
BETWEEN = "\x01"
REMEMBERED = 150_000
#: Words that are encoded in one call.
GROUP = 1024
#: Small Latin letters: below U+0250 they are their own composed forms.
SMALL = re.compile("[" + "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c == c.lower()) + "]+")
_plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How byte-level vocabularies write bytes as letters: printable ones as they are, the others from 256 on.
BYTE_LETTERS = {b: chr(b) for b in _plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _plain)}


class WordEncoder:
    """Ids of words as little-endian 32-bit numbers, remembered in two generations: words not met for a whole generation are forgotten."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.mark = self.ids(BETWEEN)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        from tokenizers import Tokenizer, pre_tokenizers

        self.letters = Tokenizer(self.tokenizer.model)  # words that need no more than the merges
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ending = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ending[i] = token.endswith("</w>")
        self.stops = {c: np.array(self.ids(chr(c)), "<u4").tobytes() for c in b",."}
        if len(self.mark) != 1:
            raise ValueError("the tokenizer has no single token for the mark between words")

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def words(self, text: bytes | None) -> list[bytes]:
        """Words, A-Z in lower case as the tokenizer has them; not where a special string might come of it."""
        return words(text, lower=b"<|" not in (text or b""))

    def learn(self, new: set[bytes]) -> None:
        """Encodes the words that aren't known. A comma or full stop after a letter is a token of its own."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        todo, ended = set(), []
        for w in new.difference(self.known):  # asks for each new word; "-" would walk all known ones
            if w in self.before:
                self.known[w] = self.before[w]
            elif w[-1] in self.stops and w[-2:-1].isalpha():
                ended.append(w)
                if w[:-1] not in self.known:
                    todo.add(w[:-1])
            else:
                todo.add(w)
        self.encode_new(list(todo))
        for w in ended:
            self.known[w] = self.known[w[:-1]] + self.stops[w[-1]]

    def encode_new(self, new: list[bytes]) -> None:
        """Small Latin letters go straight to the merges, as the tokenizer's other steps leave them alone; a word's last token is marked as such."""
        texts = b"\n".join(new).decode("utf-8", "replace").split("\n") if new else []
        easy = [i for i, t in enumerate(texts) if SMALL.fullmatch(t)]
        groups = [easy[a : a + GROUP] for a in range(0, len(easy), GROUP)]
        joined = [" ".join([texts[i] if texts[i].isascii() else new[i].decode("latin-1").translate(BYTE_LETTERS) for i in g]) for g in groups]
        for g, e in zip(groups, self.letters.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            data, at = ids.tobytes(), 0
            for i, end in zip(g, (4 * (np.flatnonzero(self.ending[ids]) + 1)).tolist(), strict=True):
                self.known[new[i]] = data[at:end]
                at = end
        rest = sorted(set(range(len(new))) - set(easy))
        if rest:
            self.encode_rest([new[i] for i in rest], [texts[i] for i in rest])

    def encode_rest(self, new: list[bytes], texts: list[str]) -> None:
        plain = [i for i, t in enumerate(texts) if BETWEEN not in t and "<|" not in t]
        groups = [plain[a : a + GROUP] for a in range(0, len(plain), GROUP)]
        joined = [f" {BETWEEN} ".join([texts[i] for i in g]) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
            if len(ends) != len(g):
                raise ValueError("a word holds the mark between words")
            data, at = ids.tobytes(), 0
            for i, end in zip(g, ends, strict=True):
                self.known[new[i]] = data[4 * at : 4 * end]
                at = end + 1
        for i in set(range(len(new))) - set(plain):
            self.known[new[i]] = np.array(self.ids(texts[i]), "<u4").tobytes()

    def encode(self, w: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, w))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One for all tasks of a worker."""
    return WordEncoder(path)


def pieces(documents: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and a piece's task and its rank among the task's pieces of its length."""
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = encoder_of(path)
        task, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in chunks(batches):
            texts = [encoder.words(t) for t in b.column("text").to_pylist()]
            encoder.learn(set().union(*texts))
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank")}
            for doc, w in zip(b.column("doc_id").to_pylist(), texts, strict=True):
                ids = encoder.encode(w) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    for c, v in zip(out, (doc, k, at // 4, n, zlib.crc32(part), task, ranks[n]), strict=True):
                        out[c].append(v)
                    ranks[n] += 1
            yield out

    return mapped(raw(documents), work, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


class Planner:
    """Sequences as (lengths, how many), from a histogram of lengths."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.pairs: np.ndarray | None = None  # which sums two available lengths have

    def pair(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        """Two available lengths that fill the gap, the first the longer."""
        if gap < 2:
            return ()
        a = np.arange((gap + 1) // 2, gap)
        ok = (left[a] > 0) & (left[gap - a] > 0)
        if gap % 2 == 0:
            ok[0] &= left[gap // 2] > 1
        at = np.flatnonzero(ok)
        return (int(a[at[-1]]), int(gap - a[at[-1]])) if len(at) else ()

    def exact(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        """One, two or three available lengths that fill the gap."""
        if left[gap] > 0:
            return (gap,)
        if found := self.pair(gap, left):
            return found
        if self.pairs is None:
            here = (self.left > 0).astype(np.float32)
            size = 1 << (2 * self.capacity + 1).bit_length()
            self.pairs = np.fft.irfft(np.fft.rfft(here, size) ** 2, size)[: self.capacity + 1] > 0.5
        a = np.arange(gap - 1, 0, -1)
        for x in a[(left[a] > 0) & self.pairs[gap - a]].tolist():
            left[x] -= 1
            rest = self.pair(gap - x, left)
            left[x] += 1
            if rest:
                return (x, *rest)
        return ()

    def sequence(self, first: int) -> tuple[int, ...]:
        """The lengths of one sequence that begins with ``first``."""
        left, out, gap = self.left.copy(), [first], self.capacity - first
        left[first] -= 1
        while gap > 0:
            if found := self.exact(gap, left):
                return (*out, *found)
            fits = np.flatnonzero(left[1 : gap + 1] > 0)
            if not len(fits):
                break
            best = int(fits[-1]) + 1
            out.append(best)
            left[best] -= 1
            gap -= best
        return tuple(out)

    def plan(self) -> list[tuple[tuple[int, ...], int]]:
        out = []
        for n in range(self.capacity, 0, -1):
            while self.left[n] > 0:
                seq = self.sequence(n)
                own, uses = np.unique(seq, return_counts=True)
                times = int((self.left[own] // uses).min())
                self.left[own] -= times * uses
                if (self.left[own] == 0).any():
                    self.pairs = None
                out.append((seq, times))
        return out


def slots(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each run, the sequence it begins with, and the offset."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    used, sequence = [0] * (capacity + 1), 0
    for seq, times in plan:
        at = 0
        for n in seq:
            runs[n].append((used[n], sequence, at))
            used[n] += times
            at += n
        sequence += times
    return [tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) if r else (np.zeros(0, np.int64),) * 3 for r in runs]


def packed(documents: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = stored(pieces(documents, path, capacity), "packing-pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        histogram[r.length] = r["count"]
    shared = documents.sparkSession.sparkContext.broadcast(slots(Planner(histogram).plan(), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = shared.value
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                first, base, at = table[n]
                k = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = base[k] + rank[own] - first[k], at[k]
            yield {c: b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset}

    return mapped(ranked, work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
