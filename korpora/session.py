"""Session settings and table access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be sent to every executor at once.
BROADCAST_BYTES = 32 << 20


def session(cpus: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects of a cluster."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("korpora")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the folder that the cluster shares (``spark.checkpoint.dir``; a local one only where all of Spark is one process): lineage ends here, and what reads it twice doesn't compute it twice."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: the executors need a folder that all of them share")
        folder = f"{tempfile.gettempdir()}/korpora-shared"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def octets(table: DataFrame, *texts: str) -> int:
    """Bytes that the rows of a written table take, counted; ``texts``: its string columns."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8 * len(table.columns)))
    return table.agg(F.sum(width.cast("long")).alias("n")).head().n or 0
