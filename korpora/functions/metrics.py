"""Text metrics: edit distance, TER, matching blocks ratio, BLEU and chrF statistics. What built-in functions lack runs in Arrow batches."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


def tokens(text: Column) -> Column:
    """Lower case, split at white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance, a column of the table at a time: differences between neighbouring cells are the bits of two integers as long as the shorter sequence."""
    if len(a) > len(b):
        a, b = b, a
    start, end = 0, 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not len(a):
        return len(b)
    places: dict = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    size = len(a) + 7 >> 3
    equal = {}
    for w, own in places.items():
        bits = bytearray(size)
        for i in own:
            bits[i >> 3] |= 1 << (i & 7)
        equal[w] = int.from_bytes(bits, "little")
    every, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = every, 0
    for w in b:
        e = equal.get(w, 0)
        x = e | down
        h = ((e & up) + up ^ up) | e
        more, less = down | every & ~(h | up), up & h
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | every & ~(x | more), more & x
    return score


@F.pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of two arrays; null if one is."""
    return pd.Series([None if x is None or y is None else distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def ter(hypothesis: Column, reference: Column) -> Column:
    """Edit distance over the reference's words; 1 for an empty reference. May exceed 1."""
    h, r = tokens(hypothesis), tokens(reference)
    return F.when(F.size(r) == 0, F.lit(1.0)).otherwise(edit_distance(h, r) / F.size(r))


class Blocks:
    """Matching blocks of two texts: the longest one first (the earliest in ``a``, then in ``b``), then those to its left and right.

    In a ``b`` of 200 characters or more those that make up over a hundredth of it start no block, they only extend one. What can start a block is compared pair by pair where pairs are few, else
    by a suffix automaton of that part of ``b``, whose work is linear.
    """

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b
        at: dict[str, list[int]] = {}
        for j, c in enumerate(b):
            at.setdefault(c, []).append(j)
        # The standard library's rule for popular characters.
        if len(b) >= 200:
            most = len(b) // 100 + 1
            at = {c: own for c, own in at.items() if len(own) <= most}
        self.at = at
        self.telling = [i for i, c in enumerate(a) if c in at]

    def matching(self) -> int:
        """Characters in blocks."""
        total, open_parts = 0, [(0, len(self.a), 0, len(self.b))]
        while open_parts:
            alo, ahi, blo, bhi = open_parts.pop()
            i, j, n = self.longest(alo, ahi, blo, bhi)
            if n:
                total += n
                if alo < i and blo < j:
                    open_parts.append((alo, i, blo, j))
                if i + n < ahi and j + n < bhi:
                    open_parts.append((i + n, ahi, j + n, bhi))
        return total

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        a, b = self.a, self.b
        places = self.telling[bisect_left(self.telling, alo) : bisect_left(self.telling, ahi)]
        pairs = sum(len(self.at[a[i]]) for i in places)
        i, j, n = (self.by_pairs if pairs <= 16 * (len(places) + bhi - blo) else self.by_automaton)(places, alo, blo, bhi)
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
            n += 1
        return i, j, n

    def by_pairs(self, places: list[int], alo: int, blo: int, bhi: int) -> tuple[int, int, int]:
        best, before, last = (alo, blo, 0), {}, -2
        for i in places:
            own = self.at[self.a[i]]
            now = {}
            if i != last + 1:
                before = {}
            for k in range(bisect_left(own, blo), bisect_left(own, bhi)):
                j = own[k]
                n = now[j] = before.get(j - 1, 0) + 1
                if n > best[2]:
                    best = (i - n + 1, j - n + 1, n)
            before, last = now, i
        return best

    def by_automaton(self, places: list[int], alo: int, blo: int, bhi: int) -> tuple[int, int, int]:
        follow, link, length, first = [{}], [-1], [0], [-1]
        state = 0
        for j in range(blo, bhi):
            c = self.b[j] if self.b[j] in self.at else j  # a place of its own separates
            new = len(length)
            follow.append({})
            length.append(length[state] + 1)
            first.append(j)
            link.append(0)
            p = state
            while p >= 0 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(length)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    while p >= 0 and follow[p].get(c) == q:
                        follow[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            state = new
        best, state, n, last = (alo, blo, 0), 0, 0, -2
        for i in places:
            if i != last + 1:
                state = n = 0
            c = self.a[i]
            while state and c not in follow[state]:
                state = link[state]
                n = length[state]
            if c in follow[state]:
                state, n = follow[state][c], n + 1
            if n > best[2]:
                best = (i - n + 1, first[state] - n + 1, n)
            last = i
        return best


def ratio(a: str, b: str) -> float:
    return 2 * Blocks(a, b).matching() / (len(a) + len(b)) if a or b else 1.0


@F.arrow_udf(DoubleType())
def matching_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Twice the matching characters over all characters, by longest matching blocks (lower case); null if one is. Rows are taken out of their batch one by one."""

    def of(x: str | None, y: str | None) -> float | None:
        return None if x is None or y is None else 1.0 if x == y else ratio(x.lower(), y.lower())

    return pa.array([of(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.float64())


class Grams:
    """The n-grams of many sequences at once, in columns: numbers of symbols, one after the other, and the sequence that each belongs to."""

    def __init__(self, sequences: list, symbols: np.ndarray):
        self.lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        self.row = np.repeat(np.arange(len(sequences)), self.lengths)
        self.symbols = symbols
        self.kinds = int(symbols.max(initial=0)) + 1
        self.gram, self.n, self.most = symbols, 1, self.kinds

    def renumbered(self, most: int) -> None:
        """Numbers the grams anew, without gaps, if a number can't be told from others in ``most`` times the room."""
        if self.most * most >= 1 << 62:
            values, self.gram = np.unique(self.gram, return_inverse=True)
            self.most = len(values)

    def longer(self) -> None:
        """From n-grams to n + 1."""
        self.renumbered(self.kinds)
        # A gram ends where the next symbol is of the same sequence.
        self.gram = self.gram[:-1] * self.kinds + self.symbols[self.n :]
        self.most *= self.kinds
        self.n += 1

    def matches(self) -> np.ndarray:
        """Of sequences 2 k and 2 k + 1 the grams in common, by count, for each k: one sort of numbers made of pair, gram and side."""
        pairs = len(self.lengths) // 2
        self.renumbered(2 * pairs)
        size = len(self.gram)
        whole = self.row[:size] == self.row[self.n - 1 :]
        row = self.row[:size][whole]
        key = np.sort(((row >> 1) * self.most + self.gram[whole]) * 2 + (row & 1))
        start = np.flatnonzero(np.diff(key, prepend=-1))
        count, key = np.diff(start, append=len(key)), key[start]
        both = np.flatnonzero((key[1:] == key[:-1] + 1) & (key[1:] & 1 == 1))  # a gram of both is two runs side by side
        return np.bincount((key[both] >> 1) // self.most, np.minimum(count[both], count[both + 1]), pairs).astype(np.int64)


#: Characters whose n-grams are sorted at a time.
SLICE = 1 << 19


def slices(pdf: pd.DataFrame, *texts: str) -> Iterator[pd.DataFrame]:
    """The rows in order, about ``SLICE`` characters at a time; a longer row is a slice of its own."""
    ends = sum(pdf[c].fillna("").str.len() for c in texts).cumsum().to_numpy()
    start = 0
    while start < len(pdf):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield pdf.iloc[start:stop]
        start = stop


def ngram_statistics(pairs: DataFrame, hypothesis: str, reference: str, *keep: str) -> DataFrame:
    """Per row the clipped matches and totals of word 1- to 4-grams and of character 1- to 6-grams (white space dropped), to be summed for a corpus. Null texts count as empty."""
    types = dict(pairs.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in keep] + ["hyp_len long, ref_len long, matches array<long>, totals array<long>, char_matches array<long>, char_hyp array<long>, char_ref array<long>"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in batches for part in slices(whole, hypothesis, reference)):
            texts = [t.split() for pair in zip(pdf[hypothesis].fillna(""), pdf[reference].fillna(""), strict=True) for t in pair]
            number: dict[str, int] = {}
            words = Grams(texts, np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64))
            joined = ["".join(t) for t in texts]
            chars = Grams(joined, np.unique(np.frombuffer("".join(joined).encode("utf-32-le"), np.uint32), return_inverse=True)[1].astype(np.int64))
            found = []
            for grams, most in ((words, 4), (chars, 6)):
                own = [grams.matches()]
                for _ in range(1, most):
                    grams.longer()
                    own.append(grams.matches())
                totals = np.maximum(grams.lengths[:, None] - np.arange(most), 0)
                found.append((np.stack(own, 1), totals[::2], totals[1::2]))
            (match, total, _), (char_match, char_hyp, char_ref) = found
            out = pd.DataFrame({"hyp_len": words.lengths[::2], "ref_len": words.lengths[1::2], "matches": list(match), "totals": list(total), "char_matches": list(char_match), "char_hyp": list(char_hyp), "char_ref": list(char_ref)})
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), out], axis=1)

    return pairs.select(*keep, hypothesis, reference).mapInPandas(work, schema)


def corpus_scores(statistics: DataFrame, *keys: str) -> DataFrame:
    """BLEU (4-grams, brevity penalty) and chrF (6-grams, beta 2) in percent from summed statistics."""
    at = lambda c, i: F.sum(F.get(c, i))
    sums = [F.sum("hyp_len").alias("h"), F.sum("ref_len").alias("r"), F.count("*").alias("n_segments")]
    sums += [at(c, i).alias(f"{c}{i}") for c, n in (("matches", 4), ("totals", 4), ("char_matches", 6), ("char_hyp", 6), ("char_ref", 6)) for i in range(n)]
    s = statistics.groupBy(*keys).agg(*sums)
    logs = sum(F.log(F.try_divide(F.col(f"matches{i}").cast("double"), F.col(f"totals{i}"))) for i in range(4)) / 4
    brevity = F.when(F.col("h") < F.col("r"), F.exp(1 - F.col("r") / F.col("h"))).otherwise(1.0)
    scores = []
    for i in range(6):
        p, r = F.try_divide(F.col(f"char_matches{i}").cast("double"), F.col(f"char_hyp{i}")), F.try_divide(F.col(f"char_matches{i}").cast("double"), F.col(f"char_ref{i}"))
        scores.append(F.coalesce(F.try_divide(5 * p * r, 4 * p + r), F.lit(0.0)))
    return s.select(*keys, "n_segments", F.coalesce(100 * brevity * F.exp(logs), F.lit(0.0)).alias("bleu"), (100 * sum(scores) / 6).alias("chrf"))
