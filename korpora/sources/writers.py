"""Sinks: TSV, JSON, JSON lines, ordered text, report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tsv(rows: DataFrame, path: str, order: list | None = None, mode: str = "overwrite") -> None:
    (rows.orderBy(*order) if order else rows).write.mode(mode).csv(path, sep="\t", header=True)


def json_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


#: Columns of the tracker of experiments.
TRACKER = ("timestamp", "name", "data", "model", "bleu_baseline", "bleu_ape", "bleu_delta", "chrf_baseline", "chrf_ape", "chrf_delta", "train_samples", "test_samples", "epochs", "batch_size", "training_hours", "notes")


def track(runs: DataFrame, folder: str) -> None:
    """Adds experiments to the tracker: a CSV folder, each file with the header. ``runs`` has any of the columns; deltas follow from the scores, to two digits, and are blank without a baseline or with one of 0."""
    delta = lambda k: F.when(F.col(f"{k}_baseline") != 0, F.round(F.col(f"{k}_ape") - F.col(f"{k}_baseline"), 2))
    whole = runs.withColumns({c: F.lit(None).cast("double") for c in ("bleu_baseline", "bleu_ape", "chrf_baseline", "chrf_ape") if c not in runs.columns})
    whole = whole.withColumns({"bleu_delta": delta("bleu"), "chrf_delta": delta("chrf")}).withColumns({c: F.lit(None).cast("string") for c in TRACKER if c not in whole.columns and not c.endswith("_delta")})
    whole.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in TRACKER]).write.mode("append").csv(folder, header=True, emptyValue="")


def text_lines(rows: DataFrame, column: str, path: str, order: list) -> None:
    """Lines in order: ranges of the order are files in order."""
    rows.orderBy(*order).select(column).write.mode("overwrite").text(path)


def id_and_text(rows: DataFrame, key: str, text: str, folder: str) -> None:
    """Two line-aligned files of ids and texts; line breaks in texts become spaces."""
    own = rows.select(F.col(key).cast("string").alias("k"), F.regexp_replace(text, r"[\r\n]+", " ").alias("t"), F.col(key).alias("o"))
    text_lines(own, "k", f"{folder}/ids", ["o"])
    text_lines(own, "t", f"{folder}/texts", ["o"])


def report(rows: DataFrame) -> DataFrame:
    """Ordered lines of a review report: per segment a header with its bucket, source and translation."""
    parts = F.array(
        F.struct(F.lit(0).alias("k"), F.format_string("[%d] %s", F.col("index"), F.upper("triage")).alias("line")),
        F.struct(F.lit(1).alias("k"), F.concat(F.lit("DE: "), F.col("source")).alias("line")),
        F.struct(F.lit(2).alias("k"), F.concat(F.lit("EN: "), F.col("translation")).alias("line")),
    )
    return rows.select("index", F.explode(parts).alias("p")).select("index", "p.k", "p.line")


def parquet_table(rows: DataFrame, name: str, mode: str = "append", partition: str | None = None) -> None:
    w = rows.write.mode(mode).format("parquet")
    (w.partitionBy(partition) if partition else w).saveAsTable(name)
