"""The feedback log as a stream: merge at a threshold, first use, and, as extensions, windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from korpora.sources.readers import FEEDBACK


def events(spark: SparkSession, folder: str, schema: str = FEEDBACK) -> DataFrame:
    """A stream of JSON-lines files as they arrive."""
    return spark.readStream.schema(schema).json(folder)


def merge_at_threshold(stream: DataFrame, pending: str, training: str, checkpoint: str, least: int = 20) -> StreamingQuery:
    """Batches gather in ``pending``; once ``least`` rows are there, all go to ``training``."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: merge_batch(batch, epoch, pending, training, least)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in system.listStatus(place)) if system.exists(place) else []


def merge_batch(batch: DataFrame, epoch: int, pending: str, training: str, least: int) -> None:
    """One batch of ``merge_at_threshold``. It may be repeated after a crash at any place: the target's folders name the last batch that they hold, and a batch that training holds already changes nothing but what pending still has of it."""
    spark = batch.sparkSession
    drop = lambda path: (place := spark._jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    merged = max((int(x.split("=")[1]) for x in folders(spark, training) if x.startswith("until=") and "_SUCCESS" in folders(spark, f"{training}/{x}")), default=-1)
    for x in folders(spark, pending):
        if x.startswith("batch=") and int(x.split("=")[1]) <= merged:
            drop(f"{pending}/{x}")
    if epoch <= merged:
        return
    batch.write.mode("overwrite").parquet(f"{pending}/batch={epoch}")
    waiting = spark.read.schema(batch.schema).parquet(pending)
    if waiting.count() >= least:
        waiting.write.mode("overwrite").parquet(f"{training}/until={epoch}")
        drop(pending)


def fill_missing(stream: DataFrame, target: str, checkpoint: str, key: str, column: str, fill) -> StreamingQuery:
    """Rows of the stream whose ``column`` is null are given to ``fill`` (rows to rows, with the column filled where it could) and kept in ``target`` by batch; rows that the target has filled already are not given again.

    A batch that is repeated after a crash writes the same folder again, so a killed and restarted stream ends with the same table; what ``fill`` left null may come again in a later batch and is then resumed.
    """
    return stream.writeStream.foreachBatch(lambda batch, epoch: fill_batch(batch, epoch, target, key, column, fill)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fill_batch(batch: DataFrame, epoch: int, target: str, key: str, column: str, fill) -> None:
    """One batch of ``fill_missing``. Only what other batches have filled counts as done; of repeated keys in a batch one row is filled."""
    spark = batch.sparkSession
    rows = batch.filter(F.col(column).isNull()).dropDuplicates([key])
    others = [f"{target}/{x}" for x in folders(spark, target) if x.startswith("batch=") and x != f"batch={epoch}" and "_SUCCESS" in folders(spark, f"{target}/{x}")]
    if others:
        done = spark.read.schema(batch.schema).parquet(*others).filter(F.col(column).isNotNull()).select(key).distinct()
        rows = rows.join(done, key, "left_anti")
    fill(rows).select(*batch.columns).write.mode("overwrite").parquet(f"{target}/batch={epoch}")


def filled(spark: SparkSession, target: str, schema, key: str, column: str) -> DataFrame:
    """What ``fill_missing`` has filled, a row a key."""
    return spark.read.schema(schema).parquet(target).filter(F.col(column).isNotNull()).dropDuplicates([key])


def first_use(stream: DataFrame, days: int = 14) -> DataFrame:
    """code, first_use, expires, used: kept as state per code; a stream of code, ts."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, used = state.get if state.exists else (None, 0)
        for pdf in batches:
            low = pdf.ts.min().to_pydatetime()
            first = low if first is None or low < first else first
            used += len(pdf)
        state.update((first, used))
        yield pd.DataFrame({"code": [key[0]], "first_use": [first], "expires": [first + pd.Timedelta(days=days)], "used": [used]})

    return stream.groupBy("code").applyInPandasWithState(update, "code long, first_use timestamp, expires timestamp, used long", "first_use timestamp, used long", "update", "NoTimeout")


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events and their mean value by window and type; rows later than the watermark are dropped by the engine."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: sessions of a user, closed by a gap."""
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and gives its last rows."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
