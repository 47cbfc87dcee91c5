"""Places of texts that may begin a term: eight bytes at a time, read as numbers (codes) and tried against a table of bits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a text that are worked on at a time.
SLICE = 1 << 18
#: Places of a term that its code is picked from; any of them would do, the rarest makes fewest rows.
PLACES = 64
#: Bits of a table: at least so many for a code, and at most 2 ** MOST in all.
BITS_A_CODE, MOST = 32, 22
#: Odd numbers whose products spread codes over a table.
SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def octets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and where the last one ends, and the bytes of all texts with eight zeros behind them. No text is null."""
    _, offsets, data = texts.cast(pa.string()).buffers()
    ends = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    own = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return ends - ends[0], np.concatenate([own[ends[0] : ends[-1]], np.zeros(8, np.uint8)])


def windows(octets: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((stop - start,), "<u8", octets, start, (1,)).copy()


def mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def slot(codes: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (codes * SPREAD[k] >> np.uint64(64 - bits)).astype(np.int64)


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eight bytes of a text as one number, at each of its first places where eight follow (all bytes of a shorter text): the number, its bytes and the text's row."""
    ends, octets = octets_of(texts)
    sizes = np.diff(ends)
    count = np.clip(sizes - 7, 1, PLACES)
    row = np.repeat(np.arange(len(sizes)), count)
    at = ends[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    n = np.minimum(sizes, 8)[row]
    return windows(octets, 0, len(octets) - 7)[at] & np.array([mask(k) for k in range(9)], np.uint64)[n], n, row


def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column key, a code of it, and the code's bytes."""
    for b in batches:
        code, n, row = codes_of(b.column("key"))
        yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row)), pa.array(code.view(np.int64)), pa.array(n.astype(np.int32))], ["key", "code", "n"])


def marks(bits: int):
    """From codes: the words of 64 bits of a table in which they set bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column("code").to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([slot(codes, k, bits) for k in range(len(SPREAD))]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    return run


def placed(lengths: list[int], table: np.ndarray, bits: int):
    """The rows with a text ``_low`` in which codes of ``lengths`` bytes may begin, and these codes; the table has some too many, but never misses one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)
        for b in batches:
            ends, octets = octets_of(b.column("_low"))
            rows, codes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for start in range(0, int(ends[-1]), SLICE):
                own = windows(octets, start, min(start + SLICE, int(ends[-1])))
                for n in lengths:
                    cut = own if n == 8 else own & mask(n)
                    at = np.flatnonzero(has[slot(cut, 0, bits)])
                    at = at[has[slot(cut[at], 1, bits)]]
                    row = np.searchsorted(ends, at + start, "right") - 1
                    whole = at + start + n <= ends[row + 1]
                    rows.append(row[whole])
                    codes.append(cut[at[whole]])
            row, code = np.concatenate(rows), np.concatenate(codes)
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            first = np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))[: len(row)]
            row, code = row[first], code[first]
            own, count = np.unique(row, return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(code.view(np.int64)))
            kept = b.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*kept.columns, lists], [*b.schema.names, "codes"])

    return run
