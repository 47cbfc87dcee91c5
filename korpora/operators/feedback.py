"""Feedback: derived ratings, edit types, patterns, disagreement with the quality estimate, samples."""

from __future__ import annotations

import re
from bisect import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from korpora.functions.lexicons import CALQUE_PATTERNS
from korpora.functions.metrics import matching_ratio
from korpora.operators.corpus import hash_order


def derived_rating(changed: Column, qe_rating: Column) -> Column:
    """good if nothing changed, major if the estimate was critical, else minor."""
    return F.when(~changed, "good").when(qe_rating == "critical", "major").otherwise("minor")


def edit_words(text: Column) -> Column:
    """Distinct words, lower case, without punctuation at the ends."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", "")), lambda w: w != ""))


#: Fixed patterns of edits, as regular expressions.
NOMINAL = r"(?i)\bthe \w+(tion|ment|ance|ence) of\b"
GENITIVE = r"(?i)\b\w+ of the \w+"
PASSIVE = r"(?i)\b(is|are|was|were|been|being) \w+ed\b"
CALQUES = tuple(f"(?i){p}" for p in CALQUE_PATTERNS)


@F.arrow_udf(IntegerType())
def inversions(a: pa.Array, b: pa.Array) -> pa.Array:
    """Number of pairs of common words that stand in another order in two texts; positions are last occurrences. Built-in functions would need all pairs of words. A row's words exist only while it is worked on."""

    def split(text: str) -> list[str]:
        return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]

    def count(x: list[str], y: list[str]) -> int:
        at, seen, n = {w: i for i, w in enumerate(y)}, [], 0
        last = {w: i for i, w in enumerate(x) if w in at}
        for w in sorted(last, key=last.get):
            k = bisect(seen, at[w])
            n += len(seen) - k
            seen.insert(k, at[w])
        return n

    return pa.array([count(split(x.as_py()), split(y.as_py())) if x.is_valid and y.is_valid else None for x, y in zip(a, b, strict=True)], pa.int32())


def edit_types(rows: DataFrame) -> DataFrame:
    """Adds edit_types and primary_type to rows with mt and corrected; order of the checks is order of precedence."""
    a, b = edit_words(F.col("mt")), edit_words(F.col("corrected"))
    r = rows.withColumn("_added", F.array_except(b, a)).withColumn("_removed", F.array_except(a, b)).withColumn("_ratio", matching_ratio("mt", "corrected"))
    added, removed = F.size("_added"), F.size("_removed")
    seq = lambda c: F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda w: w != "")
    fewer = lambda p, least: (F.regexp_count("mt", F.lit(p)) > F.regexp_count("corrected", F.lit(p))) & (F.regexp_count("mt", F.lit(p)) >= least)
    calque = F.lit(False)
    for p in CALQUES:
        calque = calque | (F.col("mt").rlike(p) & ~F.col("corrected").rlike(p))
    order = (F.size(seq("mt")) >= 5) & (F.size(seq("corrected")) >= 5) & (F.size(F.array_intersect(seq("mt"), seq("corrected"))) >= 4) & (inversions(F.lower("mt"), F.lower("corrected")) >= 3)
    checks = [
        ("terminology_swap", added.between(1, 3) & removed.between(1, 3) & (F.col("_ratio") > 0.75)),
        ("nominalization_to_verb", F.col("mt").rlike(NOMINAL) & ~F.col("corrected").rlike(NOMINAL)),
        ("word_order_restructure", order),
        ("genitive_chain_fix", fewer(GENITIVE, 1)),
        ("passive_to_active", fewer(PASSIVE, 2)),
        ("calque_fix", calque),
    ]
    found = F.filter(F.array(*[F.when(c, k) for k, c in checks]), lambda x: x.isNotNull())
    fallback = F.when((added > 2) & (removed <= 1), "addition").when((removed > 2) & (added <= 1), "deletion").otherwise("general_rephrase")
    out = r.withColumn("edit_types", F.when(F.size(found) > 0, found).otherwise(F.array(fallback)))
    return out.withColumn("primary_type", F.get("edit_types", 0)).withColumn("changed_words", F.slice(F.array_sort(F.concat("_added", "_removed")), 1, 20)).drop("_added", "_removed", "_ratio")


def statistics(rows: DataFrame) -> DataFrame:
    """One row: total, changed, unchanged, agreement (unchanged and good, or changed and not good)."""
    good = F.col("qe_rating") == "good"
    return rows.agg(F.count("*").alias("total"), F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("unchanged"), F.coalesce(F.try_divide(100.0 * F.count_if(good != F.col("changed")), F.count("*")), F.lit(0.0)).alias("agreement_pct"))


def disagreements(rows: DataFrame, key: str, most: int = 20) -> DataFrame:
    """False alarms (unchanged, rated major or critical) and misses (changed, rated good): the first of each, with full counts."""
    kind = F.when(~F.col("changed") & F.col("qe_rating").isin("major", "critical"), "false_positive").when(F.col("changed") & (F.col("qe_rating") == "good"), "false_negative")
    own = rows.withColumn("kind", kind).filter("kind IS NOT NULL")
    first = own.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(key))).filter(F.col("rank") <= most)
    return first.join(own.groupBy("kind").agg(F.count("*").alias("count")), "kind").select("kind", key, "rank", "count")


def recurring_patterns(edits: DataFrame, key: str, least: int = 3, examples: int = 15) -> DataFrame:
    """Per edit type: count, caught (estimate not good). catch_rate_ref counts within the first examples only, catch_rate over all."""
    caught = F.col("qe_rating") != "good"
    # a filter on the rank lets each task keep its first rows only; a window that feeds an aggregate would bring whole types to one task
    first = edits.withColumn("_k", F.row_number().over(Window.partitionBy("edit_type").orderBy(key))).filter(F.col("_k") <= examples)
    first = first.groupBy("edit_type").agg(F.count_if(caught).alias("caught_in_examples"))
    full = edits.groupBy("edit_type").agg(F.count("*").alias("count"), F.count_if(caught).alias("caught")).filter(F.col("count") >= least)
    out = full.join(first, "edit_type").select("edit_type", "count", "caught_in_examples", "caught")
    out = out.withColumn("catch_rate_ref", 100.0 * F.col("caught_in_examples") / F.col("count")).withColumn("catch_rate", 100.0 * F.col("caught") / F.col("count"))
    return out.withColumn("status", F.when(F.col("catch_rate_ref") < 60, "NEEDS RULE").otherwise("ok")).withColumn("actionable", 100 - F.col("catch_rate_ref") >= 40)


def report(rows: DataFrame, key: str, least: int = 3) -> DataFrame:
    """(part, k, line): the analysis of a feedback log as lines: totals, misses and false alarms, edit types by count, recurring types with how much of them the estimate catches. Counts come from aggregations; a type is a line.

    Columns ``key``, changed, qe_rating, edit_type.
    """
    bad = F.col("qe_rating").isin("major", "critical")
    totals = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("changed")).alias("same"), F.count_if("changed").alias("edited"), F.count_if(F.col("changed") & (F.col("qe_rating") == "good")).alias("missed"), F.count_if(~F.col("changed") & bad).alias("alarms"))
    head = [("Total confirmed segments: %d", "n"), ("  Accepted as-is: %d", "same"), ("  Edited before confirming: %d", "edited"), ("QE ACCURACY:", None), ("  False negatives (QE said good, translator edited): %d", "missed"), ("  False positives (QE flagged, translator accepted as-is): %d", "alarms")]
    first = totals.select(F.posexplode(F.array(*[F.format_string(text, F.col(c)) if c else F.lit(text) for text, c in head])).alias("k", "line"))
    edits = rows.filter("changed")
    types = edits.groupBy("edit_type").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "edit_type"))  # a row a type
    second = types.select(place.alias("k"), F.format_string("  %s: %d", "edit_type", "n").alias("line"))
    found = recurring_patterns(edits, key, least).withColumn("n", F.col("count"))
    status = F.when(F.col("catch_rate_ref") < 60, "NEEDS RULE").otherwise("PARTIALLY COVERED")
    third = found.select(place.alias("k"), F.format_string("  %s: %d occurrences — QE catches %.1f%% [%s]", "edit_type", "n", "catch_rate_ref", status).alias("line"))
    parts = [x.select(F.lit(p).alias("part"), F.col("k").cast("int").alias("k"), "line") for p, x in enumerate((first, second, third))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def stratified(rows: DataFrame, key: str, targets: dict[str, int], total: int, seed: int = 42) -> DataFrame:
    """Up to the target of each rating by hash order, filled up from the rest to the total."""
    shuffled = rows.withColumn("_o", hash_order(F.col(key), seed))
    target = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("rating")), F.lit(0))
    first = shuffled.withColumn("_k", F.row_number().over(Window.partitionBy("rating").orderBy("_o", key))).filter(F.col("_k") <= max(targets.values()))
    picked = first.filter(F.col("_k") <= target).drop("_k").withColumn("picked", F.lit(True))
    rest = shuffled.join(F.broadcast(picked.select(key)), key, "left_anti").orderBy("_o", key).limit(total).withColumn("picked", F.lit(False))
    return picked.unionByName(rest).orderBy(F.desc("picked"), "_o", key).limit(total).drop("_o")
