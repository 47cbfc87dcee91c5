"""N-gram Jaccard join by universe partition and pigeonhole.

A text's set holds the hashes of its distinct word shingles. For two sets of given sizes the threshold bounds how many elements they may not share (H). Sizes are cut
into bands such that linked sets lie in one band or in neighbours; for each band the universe of hashes is dealt into segments. If H differences are dealt into
more than H segments, some segment is the same in both sets: the hash of a segment is a signature. Per band the cheaper of two allocations is taken:

* segments only: m segments, an eighth more than H + 1; linked sets then have m - H signatures in common, and sets that share fewer are dropped;
* one-deletion neighbourhoods, where segments would get few elements: half as many segments, each indexed whole and with each single
  element left out, since among (H + 2) / 2 segments one has at most one difference.

Every set is indexed in its own band and the one above, and probes its own. Signatures travel packed to buckets; there the sets that share one are linked to the least of
them, their centre; a set's own centre is that with which it shares most signatures. Verification is exact, on whole shingle sets, and in two steps. First stars: every set against its centre, and for two
centres whose sets share a signature one such pair. What these links join is a class, and the sets of linked centres are a family. Then, in blocks, sets without a link to their centre meet their whole
family, and families that share as many signatures as a link needs meet. A block pair is one matrix product over the shingles that both blocks hold, and returns only links that join two classes. So a group of n copies costs n comparisons, never n * n rows. No candidate is capped or dropped.

A set is fetched again for verification by id and text hash, so null ids and ids with several texts are judged each by their text. Null and empty texts and those without words have an empty set
and stand alone. Repeated rows are one set and give a row each. An empty table gives no rows. Only doc_id and text are read; other columns, clashing names included, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpora.llm.common import LAST, Keep, buckets, chunks, mapped, pack, raw, stored, text_hash, unpack, words
from korpora.llm.components import components

MIX, MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Sets of a block in verification.
BLOCK = 512
#: Shingles of a matrix product at a time.
COLUMNS = 1 << 12
#: Elements of the sets that are signed together; a larger set is signed alone.
SLICE = 1 << 17
#: A segment of fewer elements on average is too common; one-deletion neighbourhoods take over.
LEAST_FILL = 3.6
#: A set with too many empty segments is dealt anew, so many times in all.
ROUNDS = 8
#: Ids to fetch texts for: up to so many are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MUL
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of the whole sequence if it is shorter; none without words."""
    w = words(text, lower=True)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, w)), ">u8").astype(np.uint64)
    k = min(k, len(w))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(31))) * MIX + h[i : i + len(out)]
    return np.unique(mixed(out))


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``high`` elements."""

    low: int
    high: int
    allowed: int  # differences of a pair at most
    segments: int
    deletions: bool


class Scheme:
    """Bands for a threshold of percent / 100."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        self.bands: list[Band] = []
        low = 1
        while low <= largest or len(self.bands) < 2:
            above = max(low + 1, -(-100 * low // percent))
            self.bands.append(self.band(low, above - 1))
            low = above
        self.bands.append(self.band(low, max(low, -(-100 * low // percent) - 1)))
        self.starts = np.array([b.low for b in self.bands], np.int64)

    def band(self, low: int, high: int) -> Band:
        # linked: shared >= percent / (100 + percent) * (both sizes together)
        allowed = max(0, *(s - 2 * -(-self.percent * s // (100 + self.percent)) for s in (2 * high - 1, 2 * high)))
        if low / (allowed + 1) < LEAST_FILL and allowed <= 12:
            return Band(low, high, allowed, (allowed + 2) // 2, True)
        m = allowed + 1 + -(-(allowed + 1) // 8)
        while m < 4 * allowed and m - allowed < 2 * m * np.exp(-low / m):  # room for the empty segments
            m += 1
        return Band(low, high, allowed, m, False)


def signatures(tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of many sets at once: (signature, set, probing, how many a linked set shares in this band at least). tokens: all elements; owner: the set of each.

    Bands without an allowed difference have none. Empty segments have none either, as all sets would share them: of the segments that two linked sets
    have in common (m - H; of those with a difference at most, m - H // 2) only as many can be empty (small) as the set with fewer of them has. A set that has
    enough of them to hide a link is weak: it is dealt anew, with another salt, where it meets the sets that were weak with it. What is weak in all ``ROUNDS`` deals keeps its empty ones.
    """
    out = []
    own = np.searchsorted(scheme.starts, sizes, side="right") - 1
    segments = np.array([b.segments for b in scheme.bands], np.int64)
    deletions = np.array([b.deletions for b in scheme.bands])
    allowed = np.array([b.allowed for b in scheme.bands], np.int64)
    common = np.where(deletions, segments - allowed // 2, segments - allowed)
    for step in (0, 1):
        sets = np.flatnonzero(allowed[own + step] > 0)
        for deal in range(ROUNDS):
            if not len(sets):
                break
            number = np.full(len(sizes), -1)
            number[sets] = np.arange(len(sets))
            own_tokens = number[owner] >= 0
            t, holder = tokens[own_tokens], number[owner[own_tokens]]
            band = own[sets] + step
            m = segments[band]
            first = np.concatenate([[0], np.cumsum(m)])
            salt = mixed(band.astype(np.uint64) + np.uint64(1 + (deal << 32)))
            x = mixed(t ^ salt[holder])
            seg = first[:-1][holder] + (x % m[holder].astype(np.uint64)).astype(np.int64)
            add = mixed(x + MUL)
            total = np.zeros(first[-1], np.uint64)
            np.add.at(total, seg, add)
            count = np.bincount(seg, minlength=first[-1])
            place = np.arange(first[-1]) - np.repeat(first[:-1], m)
            by = np.repeat(np.arange(len(m)), m)
            label = salt[by] + place.astype(np.uint64) * MIX
            poor = np.add.reduceat(count <= deletions[band][by], first[:-1], dtype=np.int64)
            weak = poor >= common[band]
            least = np.where(weak | deletions[band], 1, common[band] - poor)
            every = weak & (deal == ROUNDS - 1)
            some = np.flatnonzero((count > 0) | every[by])
            out.append((mixed(total[some] ^ label[some]), sets[by[some]], np.full(len(some), step == 0), least[by[some]]))
            gone = np.flatnonzero(deletions[band][holder] & ((count[seg] > 1) | every[holder]))
            if len(gone):
                out.append((mixed((total[seg[gone]] - add[gone]) ^ label[seg[gone]]), sets[holder[gone]], np.full(len(gone), step == 0), np.ones(len(gone), np.int64)))
            sets = sets[weak]
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: What is known of a document: its id, its text's hash, its set's number (equal sets of a batch have one), size and 128-bit hash.
NAMES = ("doc_id", "own", "node", "n", "h1", "h2")
ROW = f"bucket int, deal long, blob binary, {', '.join(f'{c} long' for c in NAMES)}"
EMPTY = dict.fromkeys(("bucket", "deal", "blob", *NAMES))


def columns(count: int, **given) -> dict:
    """Columns of a row of one of two kinds; those not given are null."""
    return {c: given.get(c, [None] * count) for c in EMPTY}


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def indexed(documents: DataFrame, k: int, percent: int, n_buckets: int) -> DataFrame:
    """Two kinds of rows: a document with its set's node, size and 128-bit hash (bucket -1); a bucket's packed signatures."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        task, batch = TaskContext.get().partitionId(), 0
        for b in chunks(batches):
            base = (task << 22 | batch) << 20
            batch += 1
            node_of: dict[tuple[int, int], int] = {}
            sets, rows = [], []
            for i, (doc, own, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "own", "text")), strict=True)):
                s = shingles(text, k)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                h1, h2 = (int(x) for x in np.array([h & (1 << 64) - 1, h >> 64], np.uint64).view(np.int64))
                key = (h1, h2)
                if len(s) and key not in node_of:
                    node_of[key] = base + i
                    sets.append((base + i, s))
                rows.append((doc, own, node_of.get(key, base + i), len(s), h1, h2))
            known = dict(zip(NAMES, map(list, zip(*rows, strict=True)), strict=True))
            yield columns(len(rows), bucket=[-1] * len(rows), deal=known["node"], **known)
            if not sets:
                continue
            sizes = np.array([len(s) for _, s in sets], np.int64)
            scheme = Scheme(percent, int(sizes.max()))
            slices = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1)).tolist()
            signed_sets = []
            for a, z in zip(slices, [*slices[1:], len(sets)], strict=True):
                one = signatures(np.concatenate([s for _, s in sets[a:z]]), np.repeat(np.arange(z - a), sizes[a:z]), sizes[a:z], scheme)
                signed_sets.append((one[0], one[1] + a, *one[2:]))
            sig, holder, probing, least = (np.concatenate(x) for x in zip(*signed_sets, strict=True))
            if not len(sig):
                continue
            nodes = np.array([x for x, _ in sets], np.int64)[holder]
            place = (sig % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((nodes, place))
            sig, nodes, place = sig[order], nodes[order], place[order]
            flags = (2 * least + probing)[order].astype(np.uint32)
            cut = np.ascontiguousarray(sig.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5])
            own, at = np.unique(place, return_index=True)
            ends = [*at[1:].tolist(), len(place)]
            blobs = [pack(cut[a:z], np.array([base], np.int64), (nodes[a:z] - base).astype(np.int32), flags[a:z]) for a, z in zip(at.tolist(), ends, strict=True)]
            yield columns(len(own), bucket=own.tolist(), deal=own.tolist(), blob=blobs)

    return mapped(raw(documents, text_hash().alias("own")), work, ROW)


FOUND = f"{', '.join(f'{c} long' for c in NAMES)}, signature long, least int"


def grouped(rows: DataFrame) -> DataFrame:
    """Documents pass through; of the signatures, those that two nodes or more share, one of them probing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        none = lambda n: [None] * n

        def streamed():
            for b in batches:
                is_doc = b.column("bucket").to_numpy() < 0
                docs = b.filter(pa.array(is_doc))
                if len(docs):
                    yield -1, docs
                rest = b.filter(pa.array(~is_doc))
                yield from zip(rest.column("bucket").to_pylist(), rest.column("blob").to_pylist(), strict=True)

        for bucket, group in groupby(streamed(), key=lambda r: r[0]):
            if bucket < 0:
                for _, b in group:
                    yield {c: b.column(c) for c in NAMES} | {"signature": none(len(b)), "least": none(len(b))}
                continue
            parts = [unpack(blob, np.uint8, np.int64, np.int32, np.uint32) for _, blob in group]
            # 40 bits within a bucket: sets that meet by chance are told apart in verification
            wide = np.zeros((sum(len(p[2]) for p in parts), 8), np.uint8)
            wide[:, 3:] = np.concatenate([p[0] for p in parts]).reshape(-1, 5)
            sig = wide.reshape(-1).view(">u8").astype(np.uint64) << np.uint64(24) | np.uint64(bucket)
            node = np.concatenate([p[1][0] + p[2].astype(np.int64) for p in parts])
            flags = np.concatenate([p[3] for p in parts])
            order = np.lexsort((node, sig))
            sig, node, flags = sig[order], node[order], flags[order]
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            end = np.concatenate([start[1:], [len(sig)]])
            live = (node[start] != node[end - 1]) & np.logical_or.reduceat(flags & 1, start)
            size = end - start
            keep = np.repeat(live, size)
            sig, node, least = sig[keep], node[keep], (flags[keep] >> 1).astype(np.int32)
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])[: len(sig)]
            n = int(new.sum())
            yield {"node": node[new], "signature": signed(sig[new]), "least": least[new]} | {c: none(n) for c in NAMES if c != "node"}

    return mapped(rows.repartition("deal").sortWithinPartitions("bucket"), work, FOUND)


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two blocks of sets."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    if not len(common):
        return out

    def placed(sets: list[np.ndarray], every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, every), len(common) - 1)
        hit = common[at] == every
        at, owner = at[hit], np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[hit]
        order = np.argsort(at, kind="stable")
        return owner[order], at[order]

    sides = [(len(sets), *placed(sets, every)) for sets, every in ((left, a), (right, b))]
    for c in range(0, len(common), COLUMNS):
        dense = []
        for n, owner, at in sides:
            m = np.zeros((n, min(COLUMNS, len(common) - c)), np.float32)
            x, y = np.searchsorted(at, (c, c + COLUMNS))
            m[owner[x:y], at[x:y] - c] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for all pairs of two blocks."""
    both = shared(left, right).astype(np.int64)
    size = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return 100 * both >= percent * (size - both)


def compared(tasks: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the two sides of a task that join classes (column ``class``) not joined yet. Rows: task, side, node, class, set."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "node"]).drop_duplicates(["side", "node"])  # repeated rows of a text are fetched each
        left, right = rows[rows.side == 0], rows[rows.side == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [[np.frombuffer(x, np.uint64) for x in side.elements] for side in (left, right)]
        i, j = np.nonzero(linked(*sets, percent))
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        out = []
        names, classes = (left.node.to_numpy(), right.node.to_numpy()), (left["class"].to_numpy(), right["class"].to_numpy())
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(int(classes[0][x])), root(int(classes[1][y]))
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((int(names[0][x]), int(names[1][y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return tasks.groupBy("task").applyInPandas(work, "a long, b long")


def likely(groups: DataFrame, keep: Keep) -> DataFrame:
    """(signature, node, least, centre) of nodes that share as many signatures as a link needs at least, the least such node of a signature as its centre.

    In a band of m segments linked sets have m - H in common, so a set that shares fewer with all others together has no link there.
    """
    enough = groups.groupBy("node", "least").agg(F.count("*").alias("n")).filter("n >= least").select("node", "least")
    left = keep(groups.join(enough, ["node", "least"]), "join-likely")
    centres = left.groupBy("signature").agg(F.min("node").alias("centre"), F.max("node").alias("_last")).filter("centre <> _last").select("signature", "centre")
    left = keep(left.join(centres, "signature"), "join-shared")
    enough = left.groupBy("node", "least").agg(F.count("*").alias("n")).filter("n >= least").select("node", "least")
    return keep(left.join(enough, ["node", "least"]), "join-groups")


def meeting(joined: DataFrame, keep: Keep) -> DataFrame:
    """(f, g): families whose nodes share as many signatures as a link of theirs needs at least, f < g."""
    has = joined.groupBy("signature", "family").agg(F.min("least").alias("least"))
    held = has.groupBy("signature").agg(F.count("*").alias("n")).filter("n > 1").select("signature")
    across = keep(has.join(held, "signature"), "join-across")
    other = across.select("signature", F.col("family").alias("g"), F.col("least").alias("least_g"))
    met = across.withColumnRenamed("family", "f").join(other, "signature").filter("f < g").groupBy("f", "g").agg(F.count("*").alias("n"), F.min("least").alias("a"), F.min("least_g").alias("b"))
    return met.filter("n >= a AND n >= b").select("f", "g")


def crossings(state: DataFrame, pairs: DataFrame, keep: Keep) -> DataFrame:
    """(node, class, task, side): of two families that meet the larger stays in its blocks, and the smaller ones that it meets come bundled, about a block's worth at a time."""
    sizes = state.groupBy("family").agg(F.count("*").alias("n"), F.first("blocks").alias("blocks"))
    size = lambda c: sizes.select(F.col("family").alias(c), F.col("n").alias(f"n_{c}"), F.col("blocks").alias(f"blocks_{c}"))
    both = pairs.join(size("f"), "f").join(size("g"), "g")
    ordered = both.withColumn("up", F.col("n_f") >= F.col("n_g")).select(*[F.when(F.col("up"), F.col(x)).otherwise(F.col(y)).alias(c) for c, x, y in (("owner", "f", "g"), ("part", "g", "f"), ("owner_blocks", "blocks_f", "blocks_g"), ("n", "n_g", "n_f"))])
    bundles = ordered.groupBy("owner").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("bundles"))
    ordered = keep(ordered.join(bundles, "owner").select("owner", "part", "owner_blocks", "bundles"), "join-pairs")
    at = lambda block, bundle: task("cross", "owner", block, bundle).alias("task")
    owners = ordered.select("owner", "bundles").distinct()
    own = state.join(owners, F.col("family") == F.col("owner")).withColumn("bundle", F.explode(F.sequence(F.lit(0), F.col("bundles") - 1)))
    parts = state.join(ordered, F.col("family") == F.col("part")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("owner_blocks") - 1)))
    bundle = F.pmod(F.xxhash64("part", "block"), F.col("bundles")).cast("int")
    return own.select("node", "class", at(F.col("block"), F.col("bundle")), F.lit(0).alias("side")).unionAll(parts.select("node", "class", at(F.col("at"), bundle), F.lit(1).alias("side")))


def stars(groups: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(node, family): every node with its centre; and pairs (node, centre) to compare: these, and for each two centres whose nodes share a signature one node of the one with the least node of that signature."""
    # the centre with which a node shares most signatures: chance meets once or twice, near copies many times
    met = groups.groupBy("node", "centre").agg(F.count("*").alias("n"))
    family = met.groupBy("node").agg(F.max(F.struct("n", (-F.col("centre")).alias("c"))).alias("m")).select("node", (-F.col("m.c")).alias("family"))
    family = keep(family, "join-nearest")
    held = groups.join(family, "node").groupBy("signature", "centre", "family").agg(F.min("node").alias("node"))
    led = family.select(F.col("node").alias("centre"), F.col("family").alias("to"))
    near = held.join(led, "centre").filter("family <> to").groupBy("family", "to").agg(F.min(F.struct("node", "centre")).alias("p")).select("p.node", "p.centre")
    return family, family.select("node", F.col("family").alias("centre")).unionAll(near).distinct()


def sets_of(documents: DataFrame, found: DataFrame, tasks: DataFrame, k: int, keep: Keep) -> DataFrame:
    """(node, tasks, elements) of the nodes that have tasks: the texts are read again for their sets."""
    # one row that holds the set: by id and text, as ids may be null or repeated
    rows = found.filter("signature IS NULL AND n > 0").select("node", "h1", F.struct(F.coalesce("doc_id", F.lit(int(LAST))).alias("_id"), F.col("own").alias("_own")).alias("row"))
    one = rows.groupBy("node").agg(F.min("row").alias("row"), F.first("h1").alias("h1")).select("node", "h1", "row.*")
    wanted = keep(one.join(tasks, "node"), "join-wanted")
    texts = raw(documents, text_hash().alias("_own")).withColumn("_id", F.coalesce("doc_id", F.lit(int(LAST)))).drop("doc_id")
    few = wanted.agg(F.coalesce(F.sum(F.size("tasks") + 2), F.lit(0))).head()[0] <= 3 * BROADCAST_IDS
    fetched = texts.join(F.broadcast(wanted) if few else wanted, ["_id", "_own"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in chunks(batches):
            sets = [shingles(t, k) for t in b.column("text").to_pylist()]
            h = np.array([xxhash.xxh3_128_intdigest(s.tobytes()) & (1 << 64) - 1 for s in sets], np.uint64).view(np.int64)
            own = np.flatnonzero(h == b.column("h1").to_numpy())
            part = b.take(pa.array(own))
            yield {c: part.column(c) for c in ("node", "tasks")} | {"elements": [sets[i].tobytes() for i in own]}

    return keep(mapped(fetched.select("text", "h1", "node", "tasks"), work, "node long, tasks array<struct<task: long, side: int>>, elements binary"), "join-sets")


def task(kind: str, *columns: Column | str) -> Column:
    return F.xxhash64(F.lit(kind), *columns)


def listed(tasks: DataFrame) -> DataFrame:
    """(node, tasks) from (node, task, side)."""
    return tasks.groupBy("node").agg(F.collect_list(F.struct("task", "side")).alias("tasks"))


def links(documents: DataFrame, found: DataFrame, k: int, percent: int, keep: Keep) -> DataFrame:
    """(a, b): enough links between nodes to give every component. Tasks are laid out on node numbers; the sets join them last."""
    groups = likely(found.filter("signature IS NOT NULL").select("signature", "node", "least"), keep)
    nearest, pairs = stars(groups, keep)
    pairs = keep(pairs, "join-stars")
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = pairs.join(sizes, "centre").select("node", task("star", "centre", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias("task"), F.lit(1).alias("side"))
    blocks = sizes.select(F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    centre = blocks.select("node", task("star", "node", F.col("block").cast("int")).alias("task"), F.lit(0).alias("side"))
    sets = sets_of(documents, found, listed(member.unionAll(centre)), k, keep)
    first = sets.select("node", F.col("node").alias("class"), "elements", F.explode("tasks").alias("t"))
    star = keep(compared(first.select("t.task", "t.side", "node", "class", "elements"), percent).filter("a <> b"), "join-linked")
    # what the stars have joined is a class; families whose centres are of one class are one family from here on
    joined = keep.own(components(star)).select(F.col("a").alias("node"), F.col("b").alias("class"))
    led = joined.select(F.col("node").alias("family"), F.col("class").alias("of"))
    state = nearest.join(led, "family", "left").join(joined, "node", "left").select("node", F.coalesce("of", "family").alias("family"), F.coalesce("class", "node").alias("class"))
    state = keep(state, "join-classes")
    sizes = state.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    state = keep(state.join(sizes, "family").select("node", "family", "class", block, "blocks", (F.col("class") != F.col("family")).alias("failed")), "join-states")
    # what isn't linked to its centre meets the whole family
    lefts = state.filter("failed").select("family", F.col("block").alias("left_block")).distinct()
    left = state.filter("failed").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "class", task("family", "family", "block", "other").alias("task"), F.lit(0).alias("side"))
    right = state.join(lefts, "family").select("node", "class", task("family", "family", "left_block", "block").alias("task"), F.lit(1).alias("side"))
    cross = crossings(state, meeting(groups.join(state.select("node", "family"), "node"), keep), keep)
    tasks = keep(left.unionAll(right).unionAll(cross).groupBy("node", "class").agg(F.collect_list(F.struct("task", "side")).alias("tasks")), "join-tasks")
    few = tasks.agg(F.coalesce(F.sum(F.size("tasks")), F.lit(0))).head()[0] <= 2 * BROADCAST_IDS
    rows = sets.select("node", "elements").join(F.broadcast(tasks) if few else tasks, "node").select("node", "class", "elements", F.explode("tasks").alias("t"))
    return star.unionAll(compared(rows.select("t.task", "t.side", "node", "class", "elements"), percent).filter("a <> b"))


def classes(documents: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, own (its text's hash), and first: of its class no row has a smaller id and text hash."""
    keep = Keep()
    found = keep(grouped(indexed(documents, k, percent, buckets(documents.sparkSession))), "join-signatures")
    rows = found.filter("signature IS NULL").select(*NAMES)
    full = rows.filter("n > 0")
    # stored, so that both sides of the join come from exchanges that Spark can split where a set or class is hot
    same = keep(full.groupBy("h1", "h2").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").drop("high"), "join-same")
    equal = full.join(same, ["h1", "h2"]).filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    # stored, since the links that a task returns depend on the order of its rows and are read more than once
    labels = keep.own(components(keep(links(documents, found, k, percent, keep).unionAll(equal), "join-links")))
    label = F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label")
    labelled = stored(rows.join(labels.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("doc_id", "own", "n", label), "join-labels")
    keep.drop()
    place = F.struct(F.coalesce("doc_id", F.lit(int(LAST))).alias("id"), "own")
    least = stored(labelled.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"), F.min(place).alias("_first")), "join-least")
    first = F.coalesce(place == F.col("_first"), F.lit(True))
    return labelled.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "own", first.alias("first"))


SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(rid, other) AS (SELECT rid, rid FROM d UNION SELECT rid, y FROM reach JOIN e ON x = other),
low AS (SELECT reach.rid, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = other GROUP BY reach.rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN low USING (rid) LEFT JOIN n USING (rid)"""
