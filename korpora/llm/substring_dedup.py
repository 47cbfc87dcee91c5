"""Substring deduplication by super-k-mers.

Words are the letters. The minimiser of a window of ``k`` words is the smallest hash of its ``m``-word pieces, so it depends on the window's words only.
Consecutive windows with one minimiser form a super-k-mer; it travels as one packed string to the bucket of its
minimiser, where all its windows meet every equal window of the corpus. There the windows are sorted by
128-bit fingerprint, document and start: the first of each run stays, the others are repeats.

Equal super-k-mers met by the same task are sent once (the earliest); of the others all windows are repeats already. So a
passage that fills a third of the corpus costs a row a task, not a row an occurrence. Within a bucket, minimisers seen in one
super-k-mer only need no sort. Buckets follow the session's shuffle partitions. A bucket that outgrows ``HELD`` bytes (a very frequent minimiser) is worked off in parts of that size:
each part settles its own repeats, and of its other windows only fingerprint and place go on, to be sorted by Spark, which spills, and read as a stream.

Order is (doc_id, start). A null id comes after all others. Of rows with the same id, equal starts are not earlier than one another.
Null and empty texts have no words; an empty table gives no rows; repeated rows give a row each. Windows are judged on the input only. Only doc_id, text and the columns to keep are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpora.llm.common import LAST, buckets, chunks, mapped, pack, raw, stored, unpack, words

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Windows of a super-k-mer at most; longer runs (a word over and over) are cut.
LONGEST = 512
#: Packed bytes of a bucket that are worked on at a time; unpacked they are several times as many.
HELD = 48 << 20
#: Bytes of super-k-mers whose windows are sorted at a time; one minimiser's are never parted.
SORTED = 8 << 20
#: Bytes of super-k-mers that are cut into words at a time.
CUT = 1 << 20
#: Super-k-mers that a task remembers, to send equal ones once.
REMEMBERED = 100_000


def text_hash() -> Column:
    """32 bits of the text, to tell apart rows that share an id."""
    return F.xxhash64(F.col("text").cast("binary")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def fingerprints(w: list[bytes]) -> np.ndarray:
    """n x 2 unsigned 64-bit numbers, one row a word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, w)), ">u8").astype(np.uint64).reshape(-1, 2)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A number for each k consecutive ones, by order."""
    n = len(h) - k + 1
    out = np.zeros((n, *h.shape[1:]), np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(31))) * A + h[i : i + n]
    return (out ^ (out >> np.uint64(29))) * B


def least(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive values, by doubling."""
    size, out = 1, x
    while 2 * size <= k:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - k + 1], out[k - size : k - size + len(x) - k + 1])


def super_kmers(h: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows, minimisers, and whether the minimiser stands at more than one place."""
    pieces = rolled(h[:, 0], m)
    low = least(pieces, k - m + 1)
    cut = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    ends = np.concatenate([cut[1:], [len(low)]])
    if (ends - cut).max() > LONGEST:
        cut = np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(cut, ends, strict=True)])
        ends = np.concatenate([cut[1:], [len(low)]])
    keys = low[cut]
    near = np.zeros(len(pieces) + 1, np.int64)  # pieces that come again within a window
    for d in range(1, k - m + 1):
        near[1 : len(pieces) - d + 1] |= pieces[:-d] == pieces[d:]
    near = np.cumsum(near)
    again = (ends - cut > k - m + 1) | (near[ends + k - m] > near[cut])
    return cut, ends - cut, keys, again


def sent(documents: DataFrame, n_buckets: int, k: int, m: int) -> DataFrame:
    """Rows of a bucket: packed super-k-mers. Bucket -1: windows known to be repeats, as (document, text's hash, start, windows)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: dict[bytes, tuple[int, int, int]] = {}
        for b in chunks(batches):
            if len(seen) >= REMEMBERED:
                seen.clear()
            out: dict[int, list] = {}
            known: list[tuple[int, int, int, int]] = []
            best: dict[bytes, list] = {}
            for doc, own, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "own", "text")), strict=True):
                w = words(text)
                if len(w) < k:
                    continue
                doc = LAST if doc is None else doc
                for s, n, key, again in zip(*(x.tolist() for x in super_kmers(fingerprints(w), k, m)), strict=True):
                    payload = b" ".join(w[s : s + n + k - 1])
                    first = seen.get(payload)
                    if first is not None and first[:2] <= (doc, s):
                        if first[:2] < (doc, s):
                            known.append((doc, s, own, n))
                        elif first[2] != own:  # other text under the same id
                            out.setdefault(key % n_buckets, []).append((key, doc, own, s, n, again, payload))
                        continue
                    if payload in best:  # of this batch, and not sent yet
                        known.append((*first, n))
                    seen[payload] = (doc, s, own)
                    best[payload] = [key, doc, own, s, n, again]
            for payload, row in best.items():
                out.setdefault(row[0] % n_buckets, []).append((*row, payload))
            rows = []
            for bucket, x in out.items():
                key, doc, own, s, n, again, payload = zip(*x, strict=True)
                rows.append((bucket, pack((np.array(key, np.uint64) >> np.uint64(32)).astype(np.uint32), np.array(doc, np.int64), np.array(own, np.uint32), np.array(s, np.int32), np.array(n, np.int32), np.array(again, np.uint8), b"\n".join(payload), level=6)))
            if known:
                doc, s, own, n = (np.array(x, np.int64) for x in zip(*known, strict=True))
                rows.append((-1, pack(doc, own.astype(np.uint32), s.astype(np.int32), n.astype(np.int32))))
            yield {"bucket": [r[0] for r in rows], "blob": [r[1] for r in rows]}

    return mapped(raw(documents, text_hash().alias("own")), work, "bucket int, blob binary")


RUNS = ("doc_id", "own", "start", "windows")
FOUND = (*RUNS, "f1", "f2")


def runs_of(doc: np.ndarray, own: np.ndarray, at: np.ndarray) -> dict:
    """Windows as runs of consecutive ones of a text; without fingerprints, as they are settled."""
    order = np.lexsort((at, own, doc))
    doc, own, at = doc[order], own[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (at[1:] > at[:-1] + 1)])[: len(doc)])
    last = np.concatenate([new[1:] - 1, [len(doc) - 1]])[: len(new)]
    return {"doc_id": doc[new], "own": own[new].astype(np.int64), "start": at[new].astype(np.int32), "windows": (at[last] - at[new] + 1).astype(np.int32)} | dict.fromkeys(("f1", "f2"), pa.nulls(len(new), pa.int64()))


def slices(lengths: np.ndarray, size: int, together: np.ndarray | None = None) -> Iterator[slice]:
    """Consecutive rows of about ``size`` bytes; rows of one value of ``together`` (sorted) stay in one slice."""
    at = np.cumsum(lengths) // size
    if together is not None:
        at = at[np.searchsorted(together, together, side="left")]
    cut = [*np.flatnonzero(np.diff(at, prepend=-1)).tolist(), len(at)]
    yield from (slice(a, z) for a, z in zip(cut[:-1], cut[1:], strict=True))


def repeats_of(blobs: list[bytes], k: int, whole: bool = True) -> Iterator[dict]:
    """Repeated windows of a bucket as runs; if it is a part of the bucket, its other windows with their fingerprints too.

    Equal windows have one minimiser, so the bucket is sorted by minimiser and worked off some of them at a time."""
    parts = [unpack(b, np.uint32, np.int64, np.uint32, np.int32, np.int32, np.uint8, None) for b in blobs]
    key, doc, own, start, n, again = (np.concatenate([p[i] for p in parts]) for i in range(6))
    payload = [x for p in parts for x in p.pop().split(b"\n")]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    every = np.flatnonzero((count[inverse] > 1) | (again > 0)) if whole else np.arange(len(key))
    every = every[np.argsort(key[every], kind="stable")]
    lengths = np.array([len(payload[i]) for i in every.tolist()], np.int64)
    for part in slices(lengths, SORTED, key[every]):
        rows = every[part]
        size = n[rows].astype(np.int64)
        h = np.concatenate([fingerprints(b" ".join([payload[i] for i in rows[x].tolist()]).split()) for x in slices(lengths[part], CUT)])
        first = np.concatenate([[0], np.cumsum(size + k - 1)[:-1]])  # word at which a super-k-mer begins
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        prints = rolled(h, k)[np.repeat(first, size) + inside]
        row, at = np.repeat(rows, size), np.repeat(start[rows].astype(np.int64), size) + inside
        order = np.lexsort((at, doc[row], prints[:, 1], prints[:, 0]))
        p, row, at = prints[order], row[order], at[order]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], (p[1:] != p[:-1]).any(1)]), np.arange(len(p)), 0))
        late = (doc[row] != doc[row[head]]) | (at != at[head])
        yield runs_of(doc[row[late]], own[row[late]], at[late])
        if not whole:
            p, row, at = p[~late].view(np.int64), row[~late], at[~late]
            for a in range(0, len(row), 1 << 16):
                z = a + (1 << 16)
                yield dict(zip(FOUND, (doc[row[a:z]], own[row[a:z]].astype(np.int64), at[a:z].astype(np.int32), np.ones(len(row[a:z]), np.int32), p[a:z, 0], p[a:z, 1]), strict=True))


def settled(windows: DataFrame) -> DataFrame:
    """Of windows with fingerprints those that also start earlier; sorted by Spark and read as a stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last = None  # the first window of the fingerprint that the batch before ended with: fingerprint, document, start
        for b in batches:
            if not len(b):
                continue
            doc, own, at, f1, f2 = (b.column(c).to_numpy() for c in ("doc_id", "own", "start", "f1", "f2"))
            new = np.concatenate([[last is None or last[:2] != (f1[0], f2[0])], (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])])
            head = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
            place = [np.where(head < 0, last[i] if last else 0, x[head]) for i, x in ((2, doc), (3, at))]
            late = (doc != place[0]) | (at != place[1])
            last = (f1[-1], f2[-1], place[0][-1], place[1][-1])
            yield {c: b.column(c).filter(pa.array(late)) for c in RUNS}

    rows = windows.repartition("f1", "f2").sortWithinPartitions("f1", "f2", "doc_id", "start")
    return mapped(rows, work, "doc_id long, own long, start int, windows int")


def repeats(documents: DataFrame, k: int = 20, m: int = 3) -> DataFrame:
    """doc_id (LAST for null), own (32 bits of the text's hash), start, windows: runs of windows that also start earlier. Runs may overlap."""
    packed = sent(documents, buckets(documents.sparkSession), k, m)
    held = HELD

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (r for b in batches for r in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True))
        for bucket, group in groupby(rows, key=lambda r: r[0]):
            if bucket < 0:
                for _, blob in group:
                    yield dict(zip(RUNS, unpack(blob, np.int64, np.uint32, np.int32, np.int32), strict=True)) | dict.fromkeys(("f1", "f2"))
                continue
            blobs, size, whole = [], 0, True
            for _, blob in group:
                if blobs and size + len(blob) > held:
                    whole = False
                    yield from repeats_of(blobs, k, whole)
                    blobs, size = [], 0
                blobs.append(blob)
                size += len(blob)
            yield from repeats_of(blobs, k, whole)

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for columns in work(batches):
            yield {c: pa.nulls(len(columns["doc_id"]), pa.int64()) if x is None else x for c, x in columns.items()}

    # rows that are final already are dealt by their own hash, so that they don't meet in one task
    dealt = packed.withColumn("deal", F.when(F.col("bucket") < 0, F.xxhash64("blob")).otherwise(F.col("bucket").cast("long")))
    rows = dealt.repartition("deal").sortWithinPartitions("bucket").select("bucket", "blob")
    found = stored(mapped(rows, complete, "doc_id long, own long, start int, windows int, f1 long, f2 long"), "dedup-runs")
    runs, windows = found.filter("f1 IS NULL").select(*RUNS), found.filter("f1 IS NOT NULL")
    return runs if windows.isEmpty() else runs.unionAll(settled(windows))


def deduplicated(documents: DataFrame, k: int = 20, m: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, n_words, n_removed, kept_text (kept words joined by a space; the text itself if nothing goes), kept_sha256."""
    runs = repeats(documents, k, m)
    ids = F.coalesce(F.col("doc_id"), F.lit(int(LAST)))
    by_doc = runs.groupBy(F.col("doc_id").alias("_id"), F.col("own").alias("_own")).agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    own = documents.select("doc_id", F.col("text").cast("binary").alias("text"), *keep).withColumns({"_id": ids.cast("long"), "_own": text_hash()})
    joined = own.join(by_doc, ["_id", "_own"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in chunks(batches):
            total, removed, kept, digest = [], [], [], []
            for text, cover in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                w = words(text)
                if cover and len(w) >= k:
                    gone = np.zeros(len(w) + 1, np.int32)
                    for r in cover:
                        if r["start"] + k <= len(w):
                            gone[r["start"]] += 1
                            gone[min(len(w), r["start"] + r["windows"] + k - 1)] -= 1
                    stay = np.cumsum(gone)[:-1] == 0
                    left = [x for x, y in zip(w, stay.tolist(), strict=True) if y]
                else:
                    left = w
                joined_text = b" ".join(left)
                total.append(len(w))
                removed.append(len(w) - len(left))
                kept.append(text if len(left) == len(w) else joined_text)
                digest.append(hashlib.sha256(joined_text).hexdigest())
            yield {c: b.column(c) for c in ("doc_id", *keep)} | {"n_words": total, "n_removed": removed, "kept_text": pa.array([x and x.decode("utf-8", "replace") for x in kept], pa.string()), "kept_sha256": digest}

    types = ", ".join(f"{c} {t}" for c, t in documents.select("doc_id", *keep).dtypes)
    return mapped(joined.select("doc_id", *keep, "text", "runs"), work, f"{types}, n_words long, n_removed long, kept_text string, kept_sha256 string")


SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, rank() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS p FROM r),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) a WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = a.rid AND gone.p = a.p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""
