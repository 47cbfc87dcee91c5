"""Term hints for training pairs, with terms left out at random: the model learns to work with all, some and no hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpora.functions.text import term_hint
from korpora.operators.corpus import hash_order

KEYS = ["doc_id", "idx"]


def mixed(key: Column, seed: int) -> Column:
    """A hash of 32 bits that other engines can repeat. Unlike the order that it starts from, it has nothing in common between seeds."""
    x = hash_order(key, seed * 374761393)
    for shift, factor in ((15, 1540483477), (13, 1812433253)):
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor), F.lit(4294967296))
    return x.bitwiseXOR(F.shiftright(x, 16))


def chance(key: Column, seed: int) -> Column:
    """From 0 to below 1, always the same for a key."""
    return mixed(key, seed) / F.lit(1 << 32)


def with_hints(sentences: DataFrame, found: DataFrame, drop: float = 0.25, partial: float = 0.3, seed: int = 42) -> DataFrame:
    """The keys of ``sentences`` with num_terms, mode, n_kept and hint. ``found``: doc_id, idx, rank, de, en of each sentence's terms.

    A sentence with terms loses all of them with chance ``drop``; else, if it has two or more, it keeps a random number of random ones with chance ``partial``. Chances come from hashes of the keys, so every run gives the same. ``num_terms``
    counts before anything is left out; mode is none, all, some or dropped. Sentences without terms have an empty hint.
    """
    key = F.pmod(F.col("doc_id"), F.lit(1 << 32)) * 1000 + F.col("idx")  # hashes take it modulo 2**32
    order = F.struct(mixed(key * 8 + F.col("rank"), seed + 3).alias("o"), "rank", "de", "en")
    terms = found.groupBy(*KEYS).agg(F.array_sort(F.collect_list(order)).alias("t"), F.array_sort(F.collect_list(F.struct("rank", "de", "en"))).alias("all"))
    rows = sentences.select(*KEYS).join(terms, KEYS, "left").withColumn("num_terms", F.coalesce(F.size("t"), F.lit(0)))
    mode = F.when(F.col("num_terms") <= 0, "none").when(chance(key, seed) < drop, "dropped").when((F.col("num_terms") > 1) & (chance(key, seed + 1) < partial), "some").otherwise("all")
    kept = F.when(F.col("mode") == "all", F.col("num_terms")).when(F.col("mode") == "some", 1 + F.floor(chance(key, seed + 2) * F.col("num_terms")).cast("int")).otherwise(0)
    chosen = F.when(F.col("mode") == "all", F.transform("all", lambda x: F.struct(x["de"], x["en"]))).when(F.col("mode") == "some", F.transform(F.slice("t", F.lit(1), F.col("n_kept")), lambda x: F.struct(x["de"], x["en"])))
    return rows.withColumn("mode", mode).withColumn("n_kept", kept).select(*KEYS, "num_terms", "mode", "n_kept", F.coalesce(term_hint(chosen), F.lit("")).alias("hint"))


def terms_by_split(hints: DataFrame) -> DataFrame:
    """split, n, avg_terms."""
    return hints.groupBy("split").agg(F.count("*").alias("n"), F.avg("num_terms").alias("avg_terms"))


def terms_histogram(hints: DataFrame) -> DataFrame:
    """num_terms, n, with_hint."""
    return hints.groupBy("num_terms").agg(F.count("*").alias("n"), F.count_if(F.col("hint") != "").alias("with_hint"))
