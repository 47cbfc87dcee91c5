"""A training corpus from documents: quality rules, near duplicates, repeated passages, benchmark items, packing.

Each stage takes what its predecessor kept, as Parquet, and its decisions take effect. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpora.llm import decontamination, jaccard_join, packing, quality_rules, substring_dedup
from korpora.llm.common import LAST, stored, text_hash


#: The columns of documents; a table's other columns are left behind by the first stage.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the pipeline's policy rejects."""
    return quality_rules.apply_policy(quality_rules.ledger(docs, *COLUMNS), quality_rules.PIPELINE).filter("kept").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles the one with the smallest id (and text hash, should an id have several texts); of rows that repeat an id and a text, one."""
    rows = stored(jaccard_join.classes(docs, k=5, percent=80), "pipeline-classes")
    place = [F.coalesce("doc_id", F.lit(int(LAST))).alias("_id"), "own"]
    repeated = rows.filter("first").groupBy(*place).agg(F.count("*").alias("_n")).filter("_n > 1")
    again = stored(repeated.select("_id", "own"), "pipeline-repeated")
    gone = stored(rows.filter("NOT first").select(*place).distinct().unionAll(again), "pipeline-copies")
    few = gone.count() <= jaccard_join.BROADCAST_IDS
    keyed = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(int(LAST))), "own": text_hash()})
    kept = keyed.join(F.broadcast(gone) if few else gone, ["_id", "own"], "left_anti").select(*COLUMNS)
    if again.isEmpty():
        return kept
    return kept.unionByName(keyed.join(again, ["_id", "own"], "left_semi").dropDuplicates(["_id", "own"]).select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows seen earlier; a text of which nothing is left goes."""
    rows = substring_dedup.deduplicated(docs, keep=("lang", "source")).filter("n_words > n_removed").withColumnRenamed("kept_text", "text")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontamination.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS[1:]).filter("NOT contaminated").select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", good), ("jaccard_join", one_of_each), ("substring_dedup", without_repeats), ("decontamination", uncontaminated), ("best_fit_packing", sequences)]

#: Rules and windows are SQL, but neither WAND nor the packing are.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
