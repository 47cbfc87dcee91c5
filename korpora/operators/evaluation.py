"""Evaluation: routing by errors, preferences, histograms, experiments, samples, proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpora.operators.corpus import hash_order, strip


def confident_spans(spans: Column, least: float = 0.35) -> Column:
    """Error spans of enough confidence; a missing one counts as 0."""
    return F.filter(spans, lambda s: F.coalesce(s["confidence"], F.lit(0.0)) >= least)


def routed(segments: DataFrame, least: float = 0.35) -> DataFrame:
    """Adds real_errors and skipped: only segments with real errors or violations go on to correction. Columns error_spans, violations."""
    # Exploding an array of one pins the spans: a filter on them would compute them again.
    out = segments.select(*[c for c in segments.columns if c != "real_errors"], F.explode(F.array(confident_spans(F.col("error_spans"), least))).alias("real_errors"))
    return out.withColumn("skipped", (F.size("real_errors") == 0) & (F.size("violations") == 0))


def corrected_where_needed(segments: DataFrame, correct, least: float = 0.35) -> DataFrame:
    """``segments`` with ape, changed and skipped: segments with real errors or violations go through ``correct`` (rows to rows, adding ape), the others keep their translation. Every segment comes back once; where ``correct`` gives null, the translation stays."""
    rows = routed(segments, least)
    done = correct(rows.filter(~F.col("skipped"))).withColumn("ape", F.coalesce("ape", "translation"))
    same = rows.filter("skipped").withColumn("ape", F.col("translation"))
    return done.unionByName(same).withColumn("changed", ~F.col("ape").eqNullSafe(F.col("translation")))


def preferences(rows: DataFrame) -> DataFrame:
    """One row: shares of preferred systems and mean edits; the reduction is guarded against a zero base. Columns preferred, edits_a, edits_b."""
    share = lambda k: F.coalesce(F.try_divide(100.0 * F.count_if(F.col("preferred") == k), F.count("preferred")), F.lit(0.0))
    a, b = F.avg("edits_a"), F.avg("edits_b")
    return rows.agg(F.count("*").alias("evaluated"), share("A").alias("prefer_a"), share("B").alias("prefer_b"), share("same").alias("no_preference"), a.alias("mean_a"), b.alias("mean_b"), (100.0 * (a - b) / F.greatest(F.lit(0.01), a)).alias("reduction_pct"))


def adherence(answers: Column) -> Column:
    """yes over yes and no; other answers don't count."""
    yes, no = F.count_if(answers == "yes"), F.count_if(answers == "no")
    return F.try_divide(100.0 * yes, yes + no)


def histogram(rows: DataFrame, value: Column, digits: int = 1) -> DataFrame:
    return rows.groupBy(F.bround(value, digits).alias("bin")).agg(F.count("*").alias("n"))


def experiment_deltas(rows: DataFrame) -> DataFrame:
    """delta of bleu against a baseline; a baseline of 0 counts as missing."""
    return rows.withColumn("delta", F.when(F.col("baseline") != 0, F.col("bleu") - F.col("baseline")))


def reliability(consistency: Column) -> Column:
    return F.when(consistency > 0.8, 5).otherwise(3)


def first_column_with_data(rows: DataFrame, *columns: str) -> str | None:
    """The first of the columns that any row fills."""
    have = rows.agg(*[F.coalesce(F.bool_or(F.coalesce(strip(F.col(c)) != "", F.lit(False))), F.lit(False)).alias(c) for c in columns]).head()
    return next((c for c in columns if have[c]), None)


def avoid_terms(avoid: Column, en: Column) -> Column:
    """Blank where the term to avoid is the wanted one."""
    return F.when(F.lower(strip(avoid)) == F.lower(strip(en)), "").otherwise(avoid)


def by_source(mt: Column, mt_source: Column, name: str) -> Column:
    """The machine text if its source's name holds ``name``."""
    return F.when(F.lower(mt_source).contains(name), mt)


def carve_validation(rows: DataFrame, key: str, least: int = 100, take: int = 200) -> DataFrame:
    """If val is small and train is not, the first rows of train go to val."""
    n = {r.split: r.n for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if n.get("val", 0) >= least or n.get("train", 0) <= take:
        return rows
    moved = rows.filter("split = 'train'").orderBy(key).limit(take).select(key, F.lit(True).alias("_m"))
    return rows.join(moved, key, "left").withColumn("split", F.when(F.col("_m"), "val").otherwise(F.col("split"))).drop("_m")


def random_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by hash order: the same ones each time."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


def dropout(key: Column, share: float, seed: int = 42) -> Column:
    """True for about ``share`` of the keys, always the same ones."""
    return hash_order(key, seed) < int(share * (1 << 32))


def next_open(rows: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    """One row: the least key not done."""
    return rows.join(done.select(key), key, "left_anti").agg(F.min(key).alias("next"))


def decide(proposals: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Status and time of pending proposals that have a decision (approved, rejected); others stay. Columns rule_name, status."""
    d = decisions.select("rule_name", F.col("status").alias("_s"))
    hit = (F.col("status") == "pending") & F.col("_s").isin("approved", "rejected")
    return proposals.join(d, "rule_name", "left").withColumn("decided_at", F.when(hit, now)).withColumn("status", F.when(hit, F.col("_s")).otherwise(F.col("status"))).drop("_s")


def merged_corrections(scan: DataFrame, review: DataFrame) -> DataFrame:
    """Scan entries under their term, review entries under '[review] ' and theirs; of equal keys the review's. Columns term, en."""
    keyed = review.select(F.concat(F.lit("[review] "), "term").alias("term"), "en", F.lit(1).alias("_o"))
    return scan.select("term", "en", F.lit(0).alias("_o")).unionByName(keyed).groupBy("term").agg(F.max_by("en", "_o").alias("en"))


def tag_majority(tokens: DataFrame, least: int = 1) -> DataFrame:
    """Words that are nouns in most of their occurrences, by a parser's tags."""
    out = tokens.groupBy("text").agg(F.count("*").alias("total"), F.count_if(F.col("pos").isin("NOUN", "PROPN")).alias("nouns"))
    return out.filter((F.col("nouns") > 0.5 * F.col("total")) & (F.col("total") >= least))
