"""Encoding and decoding with a vocabulary of pieces, by a table of distinct chunks.

A text is a run of chunks, each one or more space marks and the characters up to the next mark. If no piece of the vocabulary has a mark after another
character, no merge can join two chunks, so the ids of a text are those of its chunks in order, and its decoded text is theirs. Each distinct chunk is
therefore segmented once (by the vocabulary's own library), and its ids go back to the places it came from; decoding is done once a distinct chunk of a batch. ``checked`` proves the condition for
a vocabulary, and that its normalisation leaves characters alone; another vocabulary is refused.

Plan: texts become packed batches (chunk numbers by document), and a batch's distinct chunks are dealt into buckets by hash, so that all batches' copies of a chunk
meet in one bucket. A bucket segments each chunk once and answers every batch that asked; then each batch joins answers and places. A chunk that
fills a third of the corpus is one entry a batch, so no key is hot. Documents travel in their batches, never chunk by chunk.

Null text counts as empty: no ids, empty decoded text. Null ids stay null, repeated rows are encoded each, an empty table gives no rows, and other columns, clashing
names included, are left behind. A text without spaces is one chunk, however long. Bytes that are no UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.llm.common import chunks, mapped, pack, raw, unpack

MARK = "▁"
#: A chunk without its first mark: the library puts that one before a text itself.
CHUNK = re.compile(rb" ( *[^ ]+| *)")
#: Texts above this many bytes are cut one chunk at a time.
LONG = 1 << 20
BATCH_BYTES = 64 << 20
#: Of compression of what is shuffled.
LEVEL = 5
#: Chunks decoded at a time.
DECODED = 1 << 14
ROWS = "deal long, batch long, bucket int, blob binary"


@lru_cache(maxsize=2)
def checked(path: str):
    """The library's processor for a vocabulary that fits the method; ValueError for one that doesn't."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"{path}: pieces cross white space: {crossing[:5]}")
    if sp.is_unknown(sp.piece_to_id(MARK)):
        raise ValueError(f"{path}: no piece for a space alone")
    for text in (" a  b ", "\t\n x\r", "ﬁ①Ａé", "é   z", "\u0000﻿​"):
        if sp.decode(sp.encode(text)) != text:
            raise ValueError(f"{path}: the vocabulary normalises texts or can't spell all characters")
    return sp


def segmented(sp, chunks: list[str]) -> list[list[int]]:
    """The ids of chunks that lack their first mark; nothing at all is that mark alone, which the library would take for an empty text."""
    return [ids or [sp.piece_to_id(MARK)] for ids in sp.encode(chunks, num_threads=1)]


def chunked(text: bytes) -> Iterator[bytes] | list[bytes]:
    """The chunks of a text, each without its first mark."""
    if not text:
        return []
    marked = b" " + text.replace(MARK.encode(), b" ")
    return CHUNK.findall(marked) if len(text) <= LONG else (m.group(1) for m in CHUNK.finditer(marked))


#: No byte of UTF-8.
BETWEEN = b"\xff"
#: Numbers below ONE take one byte, those below TWO two, others five.
ONE, TWO = 192, 192 + 48 * 256


def planes(numbers: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, first bytes first: they compress better that way."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def joined(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def short(numbers: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Mostly small numbers in one, two or five bytes: the first bytes, the second ones, and the large numbers."""
    n = numbers.astype(np.int64)
    first = np.where(n < ONE, n, np.where(n < TWO, ONE + (n - ONE >> 8), 255)).astype(np.uint8)
    return first.tobytes(), (n[(n >= ONE) & (n < TWO)] - ONE & 255).astype(np.uint8).tobytes(), planes(n[n >= TWO])


def long(first: bytes, second: bytes, large: bytes) -> np.ndarray:
    """What ``short`` was given."""
    n = np.frombuffer(first, np.uint8).astype(np.int64)
    two, five = (n >= ONE) & (n < 255), n == 255
    n[two] = ONE + (n[two] - ONE << 8) + np.frombuffer(second, np.uint8)
    n[five] = joined(large)
    return n


def batched(documents: DataFrame, n_buckets: int, size: int) -> DataFrame:
    """Packed batches: bucket -1 has a batch's documents as chunk numbers (frequent chunks have small ones), the others its distinct chunks in order; the documents' row knows their numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, k = TaskContext.get().partitionId(), 0
        for b in chunks(batches, size):
            number: dict[bytes, int] = {}
            ids, sizes = [], []
            for text in b.column("text").to_pylist():
                own = np.fromiter((number.setdefault(c, len(number)) for c in chunked((text or b"").decode("utf-8", "replace").encode())), np.uint32)
                ids.append(own)
                sizes.append(len(own))
            ids = np.concatenate(ids)
            rank = np.empty(len(number), np.int64)
            rank[np.argsort(-np.bincount(ids, minlength=len(number)), kind="stable")] = np.arange(len(number))
            dealt: dict[int, list[bytes]] = {}
            for c in number:
                dealt.setdefault(zlib.crc32(c) % n_buckets, []).append(c)
            asked = [(j, sorted(dealt[j])) for j in sorted(dealt)]
            order = np.fromiter((number[c] for _, own in asked for c in own), np.int64, len(number))
            doc = b.column("doc_id")
            docs = pack(doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.array(doc.is_null().to_pylist(), np.uint8), np.array(sizes, np.int64), planes(rank[order]), *short(rank[ids]), level=LEVEL)
            batch = part << 32 | k
            out = [(zlib.crc32(b"%d" % batch) % n_buckets, -1, docs)] + [(j, j, pack(BETWEEN.join(own), level=LEVEL)) for j, own in asked]
            yield {"deal": [d for d, _, _ in out], "batch": [batch] * len(out), "bucket": [x for _, x, _ in out], "blob": [x for _, _, x in out]}
            k += 1

    return mapped(raw(documents), work, ROWS)


def answered(packed: DataFrame, path: str) -> DataFrame:
    """To each batch the ids of the chunks that it asked for; documents pass through."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sp = checked(path)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "batch", "blob")), strict=True))
        for bucket, group in groupby(rows, key=lambda r: r[0]):
            table: dict[bytes, bytes] = {}
            for _, batch, blob in group:
                if bucket >= 0:
                    asked = unpack(blob, None)[0].split(BETWEEN)
                    new = [c for c in asked if c not in table]
                    table.update(zip(new, (np.array(i, "<u4").tobytes() for i in segmented(sp, [c.decode() for c in new])), strict=True))
                    found = [table[c] for c in asked]
                    blob = pack(planes(np.array([len(i) // 4 for i in found])), planes(np.frombuffer(b"".join(found), "<u4")), level=LEVEL)
                yield {"deal": [0], "batch": [batch], "bucket": [bucket], "blob": [blob]}

    return mapped(packed, work, ROWS)


def spelled(replies: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded of the documents of each batch, from the answers to it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sp = checked(path)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("batch", "bucket", "blob")), strict=True))
        for batch, group in groupby(rows, key=lambda r: r[0]):
            _, bucket, blob = next(group)
            if bucket >= 0:
                raise ValueError(f"batch {batch} has no documents")
            doc, null, sizes, places, *data = unpack(blob, np.int64, np.uint8, np.int64, None, None, None, None)
            numbers, places = long(*data), joined(places)
            answers = [unpack(blob, None, None) for _, _, blob in group]
            counts = np.concatenate([joined(n) for n, _ in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
            if len(counts) != len(places):
                raise ValueError(f"batch {batch} lacks answers")
            flat = np.concatenate([joined(i) for _, i in answers]) if answers else np.zeros(0, np.uint32)
            stops = np.cumsum(counts)
            first, length = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
            first[places], length[places] = stops - counts, counts
            texts = [b""] * len(places)
            for s in range(0, len(places), DECODED):
                own = [flat[b - n : b].tolist() for b, n in zip(stops[s : s + DECODED].tolist(), counts[s : s + DECODED].tolist(), strict=True)]
                for i, t in zip(places[s : s + DECODED].tolist(), sp.decode(own), strict=True):
                    texts[i] = t.encode()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for s in range(0, len(doc), 256):
                e = min(s + 256, len(doc))
                own = numbers[ends[s] : ends[e]]
                counts = length[own]
                stops = np.concatenate([[0], np.cumsum(counts)])
                ids = flat[np.repeat(first[own] - stops[:-1], counts) + np.arange(stops[-1])]
                lists = pa.ListArray.from_arrays(pa.array(stops[ends[s : e + 1] - ends[s]].astype(np.int32)), pa.array(ids.astype(np.int32)))
                decoded = [b" ".join([texts[i] for i in numbers[a:b].tolist()]).decode() for a, b in zip(ends[s:e].tolist(), ends[s + 1 : e + 1].tolist(), strict=True)]
                yield {"doc_id": pa.array(doc[s:e], pa.int64(), mask=null[s:e].astype(bool)), "ids": lists, "decoded": decoded}

    return mapped(replies, work, "doc_id long, ids array<int>, decoded string")


def encoded(documents: DataFrame, path: str, size: int = BATCH_BYTES) -> DataFrame:
    """doc_id, ids (as the library gives them for the whole text, without begin and end) and decoded (the library's text for the ids) of every document."""
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = batched(documents, n, size).repartition(n, "deal").sortWithinPartitions("bucket", "batch")
    replies = answered(asked, path).repartition(n, "batch").sortWithinPartitions("batch", "bucket")
    return spelled(replies, path)


def digests(codes: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (UTF-8)."""
    return codes.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
