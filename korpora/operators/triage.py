"""Triage of segments, summaries, comparisons, review state, access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITY = {"good": 0, "minor": 1, "major": 2, "critical": 3}


def bucket(rating: Column, confidence: Column) -> Column:
    """green, orange or red; a missing rating counts as minor, good with an unknown confidence is red."""
    r, c = F.coalesce(rating, F.lit("minor")), F.coalesce(confidence, F.lit("medium"))
    return F.when((r == "good") & c.isin("high", "medium"), "green").when((r == "good") & (c == "low"), "orange").when(r == "minor", "orange").otherwise("red")


def by_threshold(score: Column, high: float, low: float, names: tuple[str, str, str] = ("publish", "review", "full_edit")) -> Column:
    return F.when(score >= high, names[0]).when(score >= low, names[1]).otherwise(names[2])


def severity(rating: Column) -> Column:
    out = F.when(rating == "good", 0)
    for name, k in list(SEVERITY.items())[1:]:
        out = out.when(rating == name, k)
    return out.otherwise(1)


def colour(rating: Column) -> Column:
    return F.when(rating == "good", "green").when(rating == "minor", "orange").otherwise("red")


def summary(rows: DataFrame) -> DataFrame:
    """One row: totals, counts and shares by bucket, high risks and those of them that are green. Columns triage, risk_level."""
    n = F.count("*")
    share = lambda k: F.round(F.coalesce(F.try_divide(100.0 * F.count_if(F.col("triage") == k), n), F.lit(0.0)), 1)
    return rows.agg(
        n.alias("total"),
        *[F.count_if(F.col("triage") == k).alias(k) for k in ("green", "orange", "red")],
        *[share(k).alias(f"{k}_pct") for k in ("green", "orange", "red")],
        F.count_if(F.col("risk_level") == "high").alias("high_risk_total"),
        F.count_if((F.col("risk_level") == "high") & (F.col("triage") == "green")).alias("high_risk_green"),
    )


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row over the indexes that both runs have: improved, degraded, same by severity, and the net."""
    j = a.select("index", severity(F.col("rating")).alias("x")).join(b.select("index", severity(F.col("rating")).alias("y")), "index")
    out = j.agg(F.count("*").alias("compared"), F.count_if(F.col("y") < F.col("x")).alias("improved"), F.count_if(F.col("y") > F.col("x")).alias("degraded"), F.count_if(F.col("y") == F.col("x")).alias("same"))
    return out.withColumn("net", F.col("improved") - F.col("degraded"))


def category_deltas(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Counts by category of two runs and their difference; categories of either run."""
    x = a.groupBy(column).agg(F.count("*").alias("a"))
    y = b.groupBy(column).agg(F.count("*").alias("b"))
    both = x.join(y, column, "full_outer").select(column, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.withColumn("delta", F.col("b") - F.col("a"))


def compare_systems(rows: DataFrame, high: float = 0.82, near: float = 0.01) -> DataFrame:
    """One row: two score columns d and a. Improved and same overlap for small gains; improved_clearly doesn't."""
    d, a = F.col("d"), F.col("a")
    out = rows.agg(
        F.avg("d").alias("avg_d"), F.avg("a").alias("avg_a"), F.count_if(a > d).alias("improved"), F.count_if(F.abs(a - d) < near).alias("same"), F.count_if(a < d - near).alias("worse"),
        F.count_if(a >= d + near).alias("improved_clearly"), F.count_if((a >= high) & (d < high)).alias("upgraded"), F.count_if((a < high) & (d >= high)).alias("downgraded"),
    )
    return out.withColumn("net", F.col("upgraded") - F.col("downgraded"))


def review_rows(translations: DataFrame, qe: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Translations with their judgement (rating minor if there is none), bucket, confirmed flag and the text to show."""
    j = translations.join(qe, "index", "left").join(confirmed.select("index", "confirmed_text"), "index", "left")
    return (
        j.withColumn("rating", F.coalesce("rating", F.lit("minor")))
        .withColumn("triage", bucket(F.col("rating"), F.col("confidence")))
        .withColumn("confirmed", F.col("confirmed_text").isNotNull())
        .withColumn("final", F.coalesce(F.nullif(F.col("confirmed_text"), F.lit("")), "translation"))
    )


def review_view(rows: DataFrame, view: str) -> DataFrame:
    keep = {"all": F.lit(True), "needs_review": (F.col("triage") != "green") & ~F.col("confirmed"), "red_only": F.col("triage") == "red", "confirmed": F.col("confirmed")}
    return rows.filter(keep[view])


def review_progress(rows: DataFrame) -> DataFrame:
    green = F.col("triage") == "green"
    out = rows.agg(F.count("*").alias("total"), F.count_if("confirmed").alias("confirmed"), F.count_if("confirmed").alias("_c"), F.count_if(green & ~F.col("confirmed")).alias("open_green"), F.count_if(~green & ~F.col("confirmed")).alias("needs_review"))
    return out.select("total", "confirmed", (F.col("_c") + F.col("open_green")).alias("done"), "needs_review", F.coalesce(F.try_divide(100.0 * F.col("_c"), F.col("total")), F.lit(0.0)).alias("confirmed_pct"))


def access(codes: DataFrame, usage: DataFrame, now: Column, quota: int = 3, master: str | None = None) -> DataFrame:
    """Per code asked for: verdict (master, unknown, expired after its expiry, quota, ok) and whole days left. codes: code, known."""
    j = codes.join(usage, "code", "left")
    verdict = F.when(~F.col("known"), "unknown").when(now > F.col("expires"), "expired").when(F.coalesce("used", F.lit(0)) >= quota, "quota").otherwise("ok")
    if master is not None:
        verdict = F.when(F.col("code") == master, "master").otherwise(verdict)
    return j.select("code", verdict.alias("verdict"), F.greatest(F.lit(0), F.datediff("expires", now)).alias("days_left"))


def first_use(events: DataFrame, days: int = 14) -> DataFrame:
    """code, first_use, expires, used from an event log (code, ts)."""
    return events.groupBy("code").agg(F.min("ts").alias("first_use"), (F.min("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("expires"), F.count("*").alias("used"))


def unscored(rows: DataFrame) -> DataFrame:
    """Where quality estimation is skipped: a middle score, and everything to review."""
    return rows.withColumn("score", F.lit(0.75)).withColumn("triage", F.lit("review"))


def session_log(translations: DataFrame, confirmed: DataFrame, qe: DataFrame, order: str, document: str = "unknown") -> DataFrame:
    """Events of a session: the confirmed segments, with what quality estimation said where it said anything. Of an index's repeated ratings the last by column ``order`` counts."""
    rated = qe.groupBy("index").agg(F.max_by(F.struct("rating", "error_category"), order).alias("q"))
    rows = translations.join(confirmed.filter("confirmed_text IS NOT NULL").select("index", "confirmed_text"), "index").join(rated, "index", "left")
    return rows.select(
        "index", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("translation", F.lit("")).alias("original"), F.col("confirmed_text").alias("final"),
        F.coalesce("q.rating", F.lit("unknown")).alias("qe_rating"), F.coalesce("q.error_category", F.lit("")).alias("qe_category"), F.lit(document).alias("document"),
    )


def with_reference(rows: DataFrame, references: DataFrame, *place: str) -> DataFrame:
    """Machine texts with the human text at the same place; beyond the last reference a note. References: the place and reference, one row a place."""
    return rows.join(references.select(*place, "reference"), list(place), "left").withColumn("reference", F.coalesce("reference", F.lit("(no reference available)")))
