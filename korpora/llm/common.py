"""What the operators share: words, shared storage, packed columns, remainders of ids."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z only; other letters keep their case.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Sorts after every id.
LAST = np.iinfo(np.int64).max
#: Bytes of text that are worked on at a time.
CHUNK_BYTES = 4 << 20


def words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: ``bytes.split`` splits at exactly these characters."""
    if not text:
        return []
    return (text.translate(LOWER) if lower else text).split()


def remainder(n: int, column: str = "doc_id") -> Column:
    """crc32(id as text) mod n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_hash() -> Column:
    """64 bits of the text, to tell apart rows that share an id."""
    return F.xxhash64(F.col("text").cast("binary"))


def raw(documents: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text as bytes and the named columns; others, clashing names included, are left behind."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *columns)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of about ``size`` bytes of column ``text``; a longer text is a slice of its own."""
    for batch in batches:
        lengths = np.diff(np.frombuffer(batch.column("text").cast(pa.large_binary()).buffers()[1], np.int64)[: len(batch) + 1]) if len(batch) else []
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < len(batch):
            yield batch.slice(start)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; a local one only where all of Spark is one process, as in tests."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: the executors need a folder that all of them share")
    return f"{tempfile.gettempdir()}/korpora-shared"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends here, and lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Keep:
    """``stored`` that remembers its tables, so that they can go together once nothing reads them."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return self.own(stored(df, name))

    def own(self, table: DataFrame) -> DataFrame:
        self.tables.append(table)
        return table

    def drop(self) -> None:
        for table in self.tables:
            dropped(table)
        self.tables.clear()


def buckets(spark: SparkSession) -> int:
    """Buckets of a packed shuffle: they follow the session's partitions, and so the input."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays as one compressed string."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(parts))


def unpack(blob: bytes, *types) -> list:
    """What ``pack`` was given; a type of None leaves bytes."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    lengths = np.frombuffer(data, np.int64, n, 8)
    ends = 8 * (n + 1) + np.cumsum(lengths)
    return [data[e - k : e] if t is None else np.frombuffer(data, t, int(k) // np.dtype(t).itemsize, int(e - k)) for t, k, e in zip(types, lengths, ends, strict=True)]


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow; ``work`` yields columns by name as lists or arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type, from_pandas=False) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
