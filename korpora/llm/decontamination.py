"""Benchmark decontamination by BM25 with block-max WAND.

Test items are the indexed documents: an inverted index of their words with BM25 impacts, each item's divided by its score for its own text, so that one threshold fits all. Postings are cut into
blocks of ``BLOCK`` items with the block's greatest impact. Every passage of every text (``passage`` words, half overlapping) is a query. Upper bounds come first, for all passages of a batch at
once: the commonest lists, as many as can't reach a part of the threshold in any item, are only bounded (by block, then by item); the other lists are walked and summed by passage and item, and a passage goes on if
some item's sum and these bounds reach the threshold. For these WAND walks all lists, picks the pivot by list bounds, checks it by block bounds, and skips blocks that
can't reach. Nothing at or above the threshold is lost, and all such items are retrieved, not the best few.

Verification then asks the whole text around the passage: an item is found if at least ``share`` of the distinct ``gram``-word sequences of its question (all
sentences but the last; the whole item if it has one sentence) are there, and likewise of its answer (the last sentence).

An index is broadcast and has ``MAX_ITEMS`` items at most; ``matches`` cuts a larger benchmark into shards and passes over the texts once for each, one index at a time,
with impacts from counts over all items, so the items found are those of one index. Null or wordless items are never found, null or empty texts hold nothing. Null ids and repeated rows are judged each. An empty
benchmark finds nothing; an item without an id is reported as -1, so a benchmark that uses -1 should have no null ids. An empty table gives no rows; columns that aren't kept, clashing names included, are left behind. Words are compared with A-Z in lower case and ASCII punctuation as space.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import batched, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.llm.common import LOWER, chunks, dropped, mapped, raw, stored

K1, B = 1.2, 0.75
#: A-Z in lower case, ASCII punctuation as space: a copied item is found whatever became of its punctuation.
PLAIN = bytes(32 if chr(b) in string.punctuation else b for b in LOWER)
BLOCK = 8
MAX_ITEMS = 200_000


@dataclass
class Index:
    ids: list[int]
    number: dict[bytes, int]  # word -> term
    items: list[np.ndarray]  # of a term, ascending
    impacts: list[np.ndarray]
    block: list[np.ndarray]  # greatest impact of each block
    bound: np.ndarray  # of a term; the last place is for words that no item has
    parts: list[tuple[frozenset, frozenset]]  # grams of question and answer
    walked: np.ndarray  # of a term, whether the batch filter walks its list
    rest: np.ndarray  # of an item, the sum of the lists that aren't walked
    block_rest: np.ndarray  # of a block, the greatest
    starts: np.ndarray  # all postings in one array: a term's begin here
    flat_items: np.ndarray
    flat_impacts: np.ndarray

    def hopeful(self, terms: np.ndarray, first: np.ndarray, threshold: float) -> np.ndarray:
        """Passages that might reach the threshold. terms: of each word of a batch; first: the first of the two passages that hold it (the second is the next; -1: only the next)."""
        own = np.flatnonzero(self.walked[terms])
        passage = np.concatenate([first[own], first[own] + 1])
        key = np.unique((passage + 1) * len(self.walked) + np.tile(terms[own], 2))
        passage, term = key // len(self.walked) - 1, key % len(self.walked)
        size = self.starts[term + 1] - self.starts[term]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[term], size)
        items = self.flat_items[at]
        pair, inverse = np.unique(np.repeat(passage + 1, size) * len(self.rest) + items, return_inverse=True)
        total = np.bincount(inverse, self.flat_impacts[at], len(pair))
        item = pair % len(self.rest)
        reach = total + self.block_rest[item // BLOCK] >= threshold - 1e-9
        reach[reach] = (total + self.rest[item])[reach] >= threshold - 1e-9
        return np.unique(pair[reach] // len(self.rest) - 1)

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items with a score of at least the threshold; block-max WAND over the postings of the distinct terms."""
        lists = [[0, t] for t in set(terms)]
        found = []
        items, impacts, block, bound = self.items, self.impacts, self.block, self.bound
        while lists:
            lists.sort(key=lambda x: items[x[1]][x[0]])
            total, pivot = 0.0, -1
            for k, (_, t) in enumerate(lists):
                total += bound[t]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = items[lists[pivot][1]][lists[pivot][0]]
            while pivot + 1 < len(lists) and items[lists[pivot + 1][1]][lists[pivot + 1][0]] == item:
                pivot += 1
            ahead, upto = 0.0, np.iinfo(np.int64).max
            for x in lists[: pivot + 1]:
                own = items[x[1]]
                at = x[0] if own[x[0]] >= item else x[0] + int(np.searchsorted(own[x[0] :], item))
                if at < len(own):
                    ahead += block[x[1]][at // BLOCK]
                    upto = min(upto, own[min(len(own) - 1, at // BLOCK * BLOCK + BLOCK - 1)] + 1)
            if ahead >= threshold:
                score = 0.0
                for x in lists[: pivot + 1]:
                    own = items[x[1]]
                    at = x[0] + int(np.searchsorted(own[x[0] :], item))
                    if at < len(own) and own[at] == item:
                        score += impacts[x[1]][at]
                if score >= threshold:
                    found.append((int(item), score))
                goal = item + 1
            else:
                goal = max(item + 1, upto)
                if pivot + 1 < len(lists):
                    goal = max(item + 1, min(goal, items[lists[pivot + 1][1]][lists[pivot + 1][0]]))
            for x in lists[: pivot + 1]:
                x[0] += int(np.searchsorted(items[x[1]][x[0] :], goal))
            lists = [x for x in lists if x[0] < len(items[x[1]])]
        return found


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


def grams(w: list[bytes], n: int) -> frozenset:
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@dataclass
class Counts:
    """Of all items that have words."""

    items: int = 0
    words: int = 0
    longest: int = 0
    holding: Counter = field(default_factory=Counter)  # word -> number of items


def counted(texts: Iterable[bytes]) -> Counts:
    c = Counts()
    for w in filter(None, map(terms_of, texts)):
        c.items, c.words, c.longest = c.items + 1, c.words + len(w), max(c.longest, len(w))
        c.holding.update(set(w))
    return c


def index(items: list[tuple[int, bytes]], gram: int, threshold: float = 0.4, counts: Counts | None = None) -> Index:
    """counts: of all items, if these are a part of them."""
    if len(items) > MAX_ITEMS:
        raise ValueError(f"{len(items)} items; the index is broadcast and holds {MAX_ITEMS} at most: split the items")
    split = [(i, w, t) for i, t in items if (w := terms_of(t))]
    counts = counts or counted(t for _, t in items)
    mean = counts.words / max(1, counts.items)
    post: dict[bytes, list[tuple[int, int]]] = {}
    for k, (_, w, _) in enumerate(split):
        for x in sorted(set(w)):
            post.setdefault(x, []).append((k, w.count(x)))
    length = np.array([len(w) for _, w, _ in split], float)
    number = {w: j for j, w in enumerate(post)}
    places, impacts = [], []
    for x, p in post.items():
        at, tf = np.array([k for k, _ in p], np.int64), np.array([c for _, c in p], float)
        places.append(at)
        impacts.append(np.log1p((counts.items - counts.holding[x] + 0.5) / (counts.holding[x] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[at] / mean)))
    own = np.zeros(len(split))
    for at, v in zip(places, impacts, strict=True):
        own[at] += v
    impacts = [v / own[at] for at, v in zip(places, impacts, strict=True)]
    parts = []
    for _, _, t in split:
        sentences = re.findall(rb"[^.!?]+[.!?]*", t.translate(None, b"\r"))
        sentences = [x for x in sentences if terms_of(x)]
        question, answer = (b"".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (t, b"")
        parts.append((grams(terms_of(question), gram), grams(terms_of(answer), gram)))
    bound = np.array([v.max() for v in impacts] + [0.0])
    walked = np.ones(len(bound), bool)
    rest = np.zeros(max(1, len(split)))
    for t in sorted(range(len(places)), key=lambda t: -len(places[t])):
        more = rest.copy()
        more[places[t]] += impacts[t]
        if more.max() > 0.6 * threshold:
            break
        rest, walked[t] = more, False
    walked[-1] = False
    by_block = np.maximum.reduceat(rest, np.arange(0, len(rest), BLOCK))
    starts = np.concatenate([[0], np.cumsum([len(p) for p in places]), [sum(map(len, places))]]).astype(np.int64)
    flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return Index(
        [i for i, _, _ in split], number, places, impacts, [np.maximum.reduceat(v, np.arange(0, len(v), BLOCK)) for v in impacts], bound, parts,
        walked, rest, by_block, starts, flat(places, np.int64), flat(impacts, float),
    )


def verified(w: list[bytes], parts: tuple[frozenset, frozenset], gram: int, share: float) -> bool:
    """Whether the words hold enough of the grams of question and answer; each part by its own gram length, if it is shorter."""
    for part in parts:
        if part:
            n = len(next(iter(part)))
            here = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            if len(part & here) < share * len(part):
                return False
    return True


def found(texts: list[list[bytes]], idx: Index, passage: int, threshold: float, gram: int, share: float) -> list[list[int]]:
    """For each text's words the numbers of the items that they hold."""
    none, half = len(idx.number), passage // 2
    sizes = np.array([len(w) for w in texts], np.int64)
    total = int(sizes.sum())
    if not total or not none:
        return [[] for _ in texts]
    terms = np.fromiter(chain.from_iterable(map(idx.number.get, w, repeat(none)) for w in texts), np.int64, total)
    begin = np.cumsum(sizes) - sizes
    inside = np.arange(total) - np.repeat(begin, sizes)
    # passage p of a text holds its words [p * half, p * half + passage); texts' passages are numbered one after another, with one spare before each text
    passages = sizes // half + 2
    base = np.cumsum(passages) - passages + 1
    first = np.repeat(base, sizes) + inside // half - 1
    out: list[dict[int, bool]] = [{} for _ in texts]
    hopeful = idx.hopeful(terms, first, threshold)
    owner = np.searchsorted(base - 1, hopeful, side="right") - 1
    for p, d in zip((hopeful - base[owner]).tolist(), owner.tolist(), strict=True):
        w, s = texts[d], max(0, p * half)
        e = min(len(w), p * half + passage)
        own = terms[begin[d] + s : begin[d] + e]
        for item, _ in idx.retrieve(own[own != none].tolist(), threshold):
            if not out[d].get(item):
                size = passage + sum(map(len, idx.parts[item]))
                out[d][item] = verified(w[max(0, s - size) : e + size], idx.parts[item], gram, share)
    return [sorted(k for k, v in o.items() if v) for o in out]


def matches(documents: DataFrame, benchmark: DataFrame, passage: int = 64, threshold: float = 0.4, gram: int = 3, share: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, items (ids of the items found), contaminated, of every document."""
    items = benchmark.filter(F.col("text").isNotNull()).select(F.coalesce("item_id", F.lit(-1)).alias("item_id"), F.col("text").cast("binary").alias("text"))
    rows = items.limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        del rows
        return sharded(documents, items, passage, threshold, gram, share, keep)
    own = sorted((r.item_id, bytes(r.text)) for r in rows)
    counts = counted(t for _, t in own)
    return searched(documents, index(own, gram, threshold, counts), max(passage, counts.longest), threshold, gram, share, keep)  # a passage has room for any item


def searched(documents: DataFrame, items: Index, passage: int, threshold: float, gram: int, share: float, keep: tuple[str, ...]) -> DataFrame:
    """``matches`` for the items of one index."""
    shared = documents.sparkSession.sparkContext.broadcast(items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        idx = shared.value
        for b in chunks(batches):
            hits = [[idx.ids[k] for k in own] for own in found([terms_of(t) for t in b.column("text").to_pylist()], idx, passage, threshold, gram, share)]
            own = {c: b.column(c).cast(pa.string()) if c == "text" else b.column(c) for c in ("doc_id", *keep)}
            yield own | {"items": hits, "contaminated": [bool(x) for x in hits]}

    types = "".join(f", {c} {t}" for c, t in documents.select(*keep).dtypes) if keep else ""
    return mapped(raw(documents, *(c for c in keep if c != "text")), work, f"doc_id long{types}, items array<long>, contaminated boolean")


def sharded(documents: DataFrame, items: DataFrame, passage: int, threshold: float, gram: int, share: float, keep: tuple[str, ...]) -> DataFrame:
    """``matches`` for more items than one index holds: a pass for each shard stores its finds, and the documents take up those of all shards by id and text."""
    ordered = stored(items.orderBy("item_id", "text"), "decontamination-items")
    rows = ordered.orderBy("item_id", "text")
    counts = counted(bytes(r.text) for r in rows.toLocalIterator())
    passage = max(passage, counts.longest)
    digest = F.sha2(F.col("text").cast("binary"), 256)
    finds = None
    for part in batched(((r.item_id, bytes(r.text)) for r in rows.toLocalIterator()), MAX_ITEMS):
        got = searched(documents, index(list(part), gram, threshold, counts), passage, threshold, gram, share, ("text",)).filter("contaminated")
        got = stored(got.select(F.col("doc_id").alias("_id"), digest.alias("_digest"), "items").dropDuplicates(["_id", "_digest"]), "decontamination-finds")
        finds = got if finds is None else finds.unionByName(got)
    dropped(ordered)
    finds = finds.groupBy("_id", "_digest").agg(F.sort_array(F.flatten(F.collect_list("items"))).alias("items"))
    rows = documents.select(F.col("doc_id").cast("long"), *keep, digest.alias("_own"))
    found_in = F.coalesce("items", F.array().cast("array<long>"))
    return rows.join(finds, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest")), "left").select("doc_id", *keep, found_in.alias("items"), (F.size(found_in) > 0).alias("contaminated"))
