"""Token counts by overlap resynchronisation.

A text of up to ``whole`` characters is encoded at once. A longer one is encoded in chunks that overlap, with offsets.
Two neighbouring chunks are spliced at a place where both have a token boundary and which no merge can ever cross: the
tokenizer's own first split always ends a piece before white space that follows something else, whatever stands around
it. If the overlap has no such place it is doubled, up to the end of the text, so the count is that of the whole text.

Null text counts as empty: 0 bytes, 0 tokens. Null ids stay null, repeated rows are counted each.
An empty table gives no rows; other columns, clashing names included, are left behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.llm.common import chunks, mapped, raw

#: White space as the tokenizer's pattern sees it (Unicode White_Space); a boundary here is certain after any other character.
SPACE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
EDGE = re.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def spliced(encode, text: str, chunk: int, overlap: int) -> int:
    """Number of tokens of ``text``. ``encode(str)`` gives the tokens' offsets as (start, end) in characters."""
    total, skip = 0, 0  # skip: characters of the chunk at ``at`` that are counted already
    at, here = 0, None
    while True:
        width = overlap
        end = at + chunk
        if here is None:
            here = encode(text[at : end + width])
        while True:
            if end + width >= len(text):
                return total + len(encode(text[at + skip :]))
            following = encode(text[end : end + chunk + width])
            place = common_edge(text, at, here, end, following, end + width)
            if place is not None and place > at + skip:
                break
            width *= 2
            here = encode(text[at : end + width])
        total += sum(skip <= s < place - at for s, _ in here)
        at, skip, here = end, place - end, following if width == overlap else None


def common_edge(text: str, at: int, here: list, start: int, following: list, stop: int) -> int | None:
    """The first certain boundary in the overlap text[start:stop] at which both encodings start a token."""
    left = {at + s for s, e in here if at + s > start}
    right = {start + s for s, e in following}
    for m in EDGE.finditer(text, start, stop):
        if start < m.start() < stop and m.start() in left and m.start() in right:
            return m.start()
    return None


def count_tokens(documents: DataFrame, path: str, limit: int = 1024, whole: int = 1 << 16, chunk: int = 1 << 15, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every text; special strings as the library has them by default."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        t = tokenizer(path)
        for batch in chunks(batches, 1 << 20):
            data = [x or b"" for x in batch.column("text").to_pylist()]
            texts = [x.decode("utf-8", "replace") for x in data]
            short = [i for i, x in enumerate(texts) if len(x) <= whole]
            counts = [0] * len(texts)
            for i, e in zip(short, t.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
                counts[i] = len(e)
            for i in set(range(len(texts))) - set(short):
                counts[i] = spliced(lambda s: t.encode(s, add_special_tokens=False).offsets, texts[i], chunk, overlap)
            yield {"doc_id": batch.column("doc_id"), "n_bytes": [len(x) for x in data], "n_tokens": counts}

    return mapped(raw(documents), work, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
