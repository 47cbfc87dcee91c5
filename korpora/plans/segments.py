"""Queries over rated segments, feedback, batches and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.functions import text as X
from korpora.operators import batching as B
from korpora.operators import feedback as E
from korpora.operators import structure as S
from korpora.operators import triage as T
from korpora.operators.corpus import first_wins, strip, update_column
from korpora.plans import views as V
from korpora.plans.terms import SENTENCES_SQL
from korpora.session import table


def rated(spark, d) -> DataFrame:
    return V.ratings(spark, d).withColumn("triage", T.bucket(F.col("rating"), F.col("confidence")))


def triage_v3(spark, d):
    return rated(spark, d).select("index", "triage")


def scores(spark, d) -> DataFrame:
    i = table(spark, d, "lineitem")
    return i.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 12.5).alias("a"))


SCORES = "scores AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS d, l_tax * 12.5 AS a FROM lineitem)"


def triage_thresholds_v1(spark, d):
    return scores(spark, d).groupBy(T.by_threshold(F.col("d"), 0.82, 0.68).alias("triage")).agg(F.count("*").alias("n"))


def triage_thresholds_v2(spark, d):
    return scores(spark, d).groupBy(T.by_threshold(F.col("a"), 0.92, 0.75, ("PUBLISH", "REVIEW", "FULL_EDIT")).alias("triage")).agg(F.count("*").alias("n"))


def threshold_sql(c: str, hi: float, lo: float, names: tuple[str, str, str]) -> str:
    return f"WITH {SCORES} SELECT CASE WHEN {c} >= {hi} THEN '{names[0]}' WHEN {c} >= {lo} THEN '{names[1]}' ELSE '{names[2]}' END AS triage, count(*) AS n FROM scores GROUP BY 1"


def triage_summary(spark, d):
    return T.summary(rated(spark, d))


def error_breakdown(spark, d):
    return V.ratings(spark, d).filter("rating <> 'good'").groupBy("error_category").agg(F.count("*").alias("n"))


def ab_compare(spark, d):
    r = V.ratings(spark, d)
    return T.compare_runs(r, V.second_run(r))


def category_deltas(spark, d):
    r = V.ratings(spark, d)
    return T.category_deltas(r.filter("rating <> 'good'"), V.second_run(r), "error_category")


def system_compare(spark, d):
    out = T.compare_systems(scores(spark, d))
    return out.withColumn("avg_d", F.round("avg_d", 6)).withColumn("avg_a", F.round("avg_a", 6))


def review(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("translation"))
    confirmed = docs.filter("index % 6 = 0").select("index", F.when(F.col("index") % 12 == 0, "").otherwise(F.lower("translation")).alias("confirmed_text"))
    return T.review_rows(docs, V.ratings(spark, d), confirmed)


REVIEW = f"""{V.RATINGS}, review AS (SELECT d.doc_id AS "index", d.text AS translation, coalesce(rating, 'minor') AS rating, {V.BUCKET} AS triage, d.doc_id % 6 = 0 AS confirmed,
  CASE WHEN d.doc_id % 6 = 0 AND d.doc_id % 12 <> 0 THEN lower(d.text) ELSE d.text END AS final FROM documents d LEFT JOIN ratings r ON r."index" = d.doc_id)"""


def review_progress(spark, d):
    return T.review_progress(review(spark, d))


def feedback_rating(spark, d):
    f = V.feedback(spark, d)
    return f.groupBy(E.derived_rating(F.col("changed"), F.col("qe_rating")).alias("rating")).agg(F.count("*").alias("n"))


def feedback_stats(spark, d):
    return E.statistics(V.feedback(spark, d))


def qe_disagreements(spark, d):
    return E.disagreements(V.feedback(spark, d), "event_id")


def recurring_patterns(spark, d):
    return E.recurring_patterns(V.feedback(spark, d).filter("changed"), "event_id")


def few_shot_stratified(spark, d):
    return E.stratified(V.ratings(spark, d), "index", {"good": 10, "minor": 10, "major": 7, "critical": 3}, 40).select("index", "rating", "picked")


def feedback_first_seen(spark, d):
    """First event of each user and type, as pending feedback is read."""
    return first_wins(V.feedback(spark, d), ["code", "edit_type"], "event_id").select("code", "edit_type", "event_id")


def last_evaluation(spark, d):
    """The last event of each user wins."""
    return V.feedback(spark, d).groupBy("code").agg(F.max_by(F.col("edit_type"), F.struct("ts", "event_id")).alias("edit_type"), F.count("*").alias("n"))


def usage_gate(spark, d):
    f = V.feedback(spark, d)
    usage = T.first_use(f)
    codes = f.select("code").distinct().withColumn("known", F.col("code") % 10 != 3)
    return T.access(codes, usage.withColumn("used", F.col("used") % 5), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


def first_use_expiry(spark, d):
    return T.first_use(V.feedback(spark, d))


def batch_overlap_owner(spark, d):
    s = V.sentences(spark, d)
    n = s.groupBy("doc_id").agg(F.count("*").alias("n"))
    return B.overlapping(s.select("doc_id", "idx").join(n, "doc_id"), 20, 5).select("doc_id", "idx", "batch", "local", "owner")


def fixed_batches(spark, d):
    return V.sentences(spark, d).groupBy("doc_id", B.batch_of(F.col("idx"), 10).alias("batch")).agg(F.count("*").alias("n"), F.min("idx").alias("start"))


def feature_rows(spark, d) -> DataFrame:
    """Sentences with features drawn from their lengths, in place of a parser's."""
    n = F.size(X.words(F.col("sentence")))
    k = F.length("sentence")
    return V.sentences(spark, d).select(
        "doc_id", "idx", n.alias("n_tokens"), (k % 5).alias("clause_depth"), (k % 13).alias("max_verb_final_span"), (k % 3).alias("n_verb_final_clauses"), (n % 4).alias("n_relative_clauses"),
        (n % 3).alias("n_participial_constructions"), (k % 7).alias("max_participial_span"), (k % 11).alias("vorfeld_length"),
    )


def risk_score(spark, d):
    return S.scored(feature_rows(spark, d)).select("doc_id", "idx", "risk_score", "risk_level", F.array_join("risk_factors", ";").alias("factors"))


def risk_summary(spark, d):
    out = S.summary(S.scored(feature_rows(spark, d)))
    return out.select("sentences", "high", "medium", "low", "max_depth")


RISK = rf"""{SENTENCES_SQL}, f AS (SELECT doc_id, idx, len(regexp_extract_all(sentence, '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS n, length(sentence) AS k FROM sentences),
g AS (SELECT doc_id, idx, n, CASE WHEN n < 4 THEN 0 ELSE k % 5 END AS depth, CASE WHEN n < 4 THEN 0 ELSE k % 13 END AS span, CASE WHEN n < 4 THEN 0 ELSE n % 4 END AS rc, CASE WHEN n < 4 THEN 0 ELSE n % 3 END AS part, CASE WHEN n < 4 THEN 0 ELSE k % 7 END AS pspan, CASE WHEN n < 4 THEN 0 ELSE k % 11 END AS vf FROM f),
s AS (SELECT *, CASE WHEN n < 4 THEN 0.0::DOUBLE ELSE round((least(greatest(n - 10, 0) / 160, 0.25) + least(depth / 3, 1) * 0.25 + least(span / 10, 1) * 0.2 + least(rc / 2, 1) * 0.1 + least(least(part / 2, 1) * 0.1 + CASE WHEN pspan > 4 THEN 0.05 ELSE 0 END, 0.1) + least(greatest(vf - 3, 0) / 7, 1) * 0.1)::DOUBLE, 3) END AS risk_score FROM g),
r AS (SELECT *, CASE WHEN risk_score >= 0.5 THEN 'high' WHEN risk_score >= 0.25 THEN 'medium' ELSE 'low' END AS risk_level FROM s)"""


def high_risk_top5(spark, d):
    """The five riskiest sentences."""
    return S.scored(feature_rows(spark, d)).orderBy(F.desc("risk_score"), "doc_id", "idx").limit(5).select("doc_id", "idx", F.col("n_tokens").cast("int").alias("n_tokens"))


def changed_flags(spark, d):
    return V.translated(spark, d).select("id", (strip(F.col("mt")) != strip(F.col("ref"))).alias("changed"))


def mt_updates(spark, d):
    """Rows updated by key where there is an update."""
    r = V.pairs(spark, d).select("id", F.lit(None).cast("string").alias("mt"))
    new = V.pairs(spark, d).filter("id % 2 = 0").select("id", F.col("ref").alias("mt"))
    return update_column(r, new, "id", "mt").groupBy(F.col("mt").isNull().alias("open")).agg(F.count("*").alias("n"))


def text_search(spark, d):
    p = V.pairs(spark, d)
    return p.filter(F.coalesce(F.col("src").ilike("%tion%"), F.lit(False)) | F.coalesce(F.col("ref").ilike("%heed%"), F.lit(False))).select("id")


def edit_types(spark, d):
    p = V.translated(spark, d).select("id", "mt", F.col("ref").alias("corrected"))
    return E.edit_types(p).select("id", "primary_type", F.size("edit_types").alias("n_types"))


def provider_pipeline(spark, d):
    """Sentences through the provider and the triage."""
    p = B.provided(V.sentences(spark, d), B.StubProvider())
    return p.groupBy(T.bucket(F.col("rating"), F.col("confidence")).alias("triage")).agg(F.count("*").alias("n"))


def prompts(spark, d):
    """Batch prompts with structural notes, built in order."""
    s = V.sentences(spark, d).join(S.scored(feature_rows(spark, d)), ["doc_id", "idx"]).withColumn("hint", F.col("translation_hint"))
    n = V.sentences(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    return B.prompt(B.overlapping(s.join(n, "doc_id"), 50, 5), ["doc_id", "batch"])


def json_answers(spark, d):
    """Ratings parsed from answers, whole and cut ones."""
    rows = V.ratings(spark, d).groupBy(F.floor(F.col("index") / 10).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("index", "rating", "error_category"))).alias("a"))
    text = F.concat(F.lit("```json\n["), F.array_join(F.transform("a", lambda x: F.format_string('{"rating": "%s", "error_category": "%s"}', x["rating"], x["error_category"])), ", "), F.when(F.col("batch") % 3 == 0, F.lit(', {"rating": "goo')).otherwise("]\n```"))
    return B.parsed_ratings(rows.select("batch", text.alias("response"), F.size("a").alias("expected")), "batch").groupBy("rating").agg(F.count("*").alias("n"))


def numbered_answers(spark, d):
    """Numbered answers of whole documents taken apart and padded."""
    rows = V.sentences(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "sentence"))).alias("a"))
    text = F.array_join(F.transform("a", lambda x: F.concat(F.lit("["), (x["idx"] + 1).cast("string"), F.lit("] "), x["sentence"])), "\n")
    return B.parsed_numbered(rows.select("doc_id", text.alias("response"), (F.size("a") + 1).alias("expected")), "doc_id")


def report_rows(spark, d):
    """Segments of a rendered report, read back: a running count of headers is the segment."""
    from pyspark.sql import Window

    lines = review(spark, d).select("index", F.explode(F.array(F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), F.upper("triage")), F.concat(F.lit("EN: "), F.col("final")))).alias("line"))
    lines = lines.withColumn("k", F.when(F.col("line").startswith("["), 0).otherwise(1))
    seg = F.count_if(F.col("k") == 0).over(Window.partitionBy(F.floor(F.col("index") / 100)).orderBy("index", "k"))
    part = lines.withColumn("block", F.floor(F.col("index") / 100)).withColumn("seg", seg)
    return part.groupBy("block", "seg").agg(F.max(F.when(F.col("k") == 0, F.split("line", " ")[1])).alias("label"), F.max(F.when(F.col("k") == 1, F.length("line"))).alias("chars"))


QUERIES = {
    "triage_v3": (triage_v3, f'WITH {V.RATINGS} SELECT "index", {V.BUCKET} AS triage FROM ratings'),
    "triage_thresholds_v1": (triage_thresholds_v1, threshold_sql("d", 0.82, 0.68, ("publish", "review", "full_edit"))),
    "triage_thresholds_v2": (triage_thresholds_v2, threshold_sql("a", 0.92, 0.75, ("PUBLISH", "REVIEW", "FULL_EDIT"))),
    "triage_summary": (triage_summary, f"""WITH {V.RATINGS}, t AS (SELECT *, {V.BUCKET} AS triage FROM ratings) SELECT count(*) AS total, count(*) FILTER (triage = 'green') AS green, count(*) FILTER (triage = 'orange') AS orange, count(*) FILTER (triage = 'red') AS red,
  round(100.0::DOUBLE * count(*) FILTER (triage = 'green') / count(*), 1) AS green_pct, round(100.0::DOUBLE * count(*) FILTER (triage = 'orange') / count(*), 1) AS orange_pct, round(100.0::DOUBLE * count(*) FILTER (triage = 'red') / count(*), 1) AS red_pct,
  count(*) FILTER (risk_level = 'high') AS high_risk_total, count(*) FILTER (risk_level = 'high' AND triage = 'green') AS high_risk_green FROM t"""),
    "error_breakdown": (error_breakdown, f"WITH {V.RATINGS} SELECT error_category, count(*) AS n FROM ratings WHERE rating <> 'good' GROUP BY 1"),
    "ab_compare": (ab_compare, f"""WITH {V.RATINGS}, {V.SECOND}, s(rating, k) AS (VALUES ('good', 0), ('minor', 1), ('major', 2), ('critical', 3)),
j AS (SELECT x.k AS x, y.k AS y FROM ratings a JOIN second b USING ("index") JOIN s x ON x.rating = a.rating JOIN s y ON y.rating = b.rating)
SELECT count(*) AS compared, count(*) FILTER (y < x) AS improved, count(*) FILTER (y > x) AS degraded, count(*) FILTER (y = x) AS same, count(*) FILTER (y < x) - count(*) FILTER (y > x) AS net FROM j"""),
    "category_deltas": (category_deltas, f"""WITH {V.RATINGS}, {V.SECOND}, x AS (SELECT error_category, count(*) AS a FROM ratings WHERE rating <> 'good' GROUP BY 1), y AS (SELECT error_category, count(*) AS b FROM second GROUP BY 1)
SELECT error_category, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(b, 0) - coalesce(a, 0) AS delta FROM x FULL JOIN y USING (error_category)"""),
    "system_compare": (system_compare, f"""WITH {SCORES} SELECT round(avg(d), 6) AS avg_d, round(avg(a), 6) AS avg_a, count(*) FILTER (a > d) AS improved, count(*) FILTER (abs(a - d) < 0.01) AS same, count(*) FILTER (a < d - 0.01) AS worse, count(*) FILTER (a >= d + 0.01) AS improved_clearly,
  count(*) FILTER (a >= 0.82 AND d < 0.82) AS upgraded, count(*) FILTER (a < 0.82 AND d >= 0.82) AS downgraded, count(*) FILTER (a >= 0.82 AND d < 0.82) - count(*) FILTER (a < 0.82 AND d >= 0.82) AS net FROM scores"""),
    "review_progress": (review_progress, f"""WITH {REVIEW} SELECT count(*) AS total, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (confirmed OR triage = 'green') AS done, count(*) FILTER (NOT confirmed AND triage <> 'green') AS needs_review, 100.0::DOUBLE * count(*) FILTER (confirmed) / count(*) AS confirmed_pct FROM review"""),
    "feedback_rating": (feedback_rating, f"WITH {V.FEEDBACK} SELECT CASE WHEN NOT changed THEN 'good' WHEN qe_rating = 'critical' THEN 'major' ELSE 'minor' END AS rating, count(*) AS n FROM feedback GROUP BY 1"),
    "feedback_stats": (feedback_stats, f"WITH {V.FEEDBACK} SELECT count(*) AS total, count(*) FILTER (changed) AS changed, count(*) FILTER (NOT changed) AS unchanged, 100.0::DOUBLE * count(*) FILTER ((qe_rating = 'good') <> changed) / count(*) AS agreement_pct FROM feedback"),
    "qe_disagreements": (qe_disagreements, f"""WITH {V.FEEDBACK}, k AS (SELECT event_id, CASE WHEN NOT changed AND qe_rating IN ('major', 'critical') THEN 'false_positive' WHEN changed AND qe_rating = 'good' THEN 'false_negative' END AS kind FROM feedback),
r AS (SELECT kind, event_id, row_number() OVER (PARTITION BY kind ORDER BY event_id) AS rank, count(*) OVER (PARTITION BY kind) AS count FROM k WHERE kind IS NOT NULL) SELECT kind, event_id, rank::INT AS rank, count FROM r WHERE rank <= 20"""),
    "recurring_patterns": (recurring_patterns, f"""WITH {V.FEEDBACK}, r AS (SELECT *, row_number() OVER (PARTITION BY edit_type ORDER BY event_id) AS k FROM feedback WHERE changed),
a AS (SELECT edit_type, count(*) AS count, count(*) FILTER (qe_rating <> 'good' AND k <= 15) AS caught_in_examples, count(*) FILTER (qe_rating <> 'good') AS caught FROM r GROUP BY 1 HAVING count(*) >= 3)
SELECT *, 100.0::DOUBLE * caught_in_examples / count AS catch_rate_ref, 100.0::DOUBLE * caught / count AS catch_rate, CASE WHEN 100.0 * caught_in_examples / count < 60 THEN 'NEEDS RULE' ELSE 'ok' END AS status, 100 - 100.0 * caught_in_examples / count >= 40 AS actionable FROM a"""),
    "few_shot_stratified": (few_shot_stratified, f"""WITH {V.RATINGS}, o AS (SELECT *, ("index" * 2654435761 + 42) % 4294967296 AS o FROM ratings), r AS (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY o, "index") <= CASE rating WHEN 'good' THEN 10 WHEN 'minor' THEN 10 WHEN 'major' THEN 7 ELSE 3 END AS picked FROM o)
SELECT "index", rating, picked FROM r ORDER BY picked DESC, o, "index" LIMIT 40"""),
    "feedback_first_seen": (feedback_first_seen, f"WITH {V.FEEDBACK} SELECT code, edit_type, min(event_id) AS event_id FROM feedback GROUP BY 1, 2"),
    "last_evaluation": (last_evaluation, f"WITH {V.FEEDBACK}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY code) AS n FROM feedback) SELECT code, edit_type, n FROM r WHERE k = 1"),
    "usage_gate": (usage_gate, f"""WITH {V.FEEDBACK}, u AS (SELECT code, min(ts) + INTERVAL 14 DAY AS expires, count(*) % 5 AS used FROM feedback GROUP BY 1)
SELECT code, CASE WHEN code % 10 = 3 THEN 'unknown' WHEN TIMESTAMP '2024-01-20' > expires THEN 'expired' WHEN used >= 3 THEN 'quota' ELSE 'ok' END AS verdict, greatest(0, date_diff('day', DATE '2024-01-20', expires::DATE))::INT AS days_left FROM u"""),
    "first_use_expiry": (first_use_expiry, f"WITH {V.FEEDBACK} SELECT code, min(ts) AS first_use, min(ts) + INTERVAL 14 DAY AS expires, count(*) AS used FROM feedback GROUP BY 1"),
    "batch_overlap_owner": (batch_overlap_owner, f"""WITH {SENTENCES_SQL}, n AS (SELECT doc_id, idx, count(*) OVER (PARTITION BY doc_id) AS n FROM sentences), b AS (SELECT doc_id, idx, n, unnest(range(0, greatest(0, ceil((n - 20) / 15))::BIGINT + 1)) AS batch FROM n)
SELECT doc_id, idx, batch, idx - batch * 15 AS local, batch = min(batch) OVER (PARTITION BY doc_id, idx) AS owner FROM b WHERE idx >= batch * 15 AND idx < batch * 15 + 20"""),
    "fixed_batches": (fixed_batches, f"WITH {SENTENCES_SQL} SELECT doc_id, (idx // 10)::BIGINT AS batch, count(*) AS n, min(idx) AS start FROM sentences GROUP BY 1, 2"),
    "risk_score": (risk_score, f"""WITH {RISK} SELECT doc_id, idx, risk_score, risk_level, CASE WHEN n < 4 THEN '' ELSE concat_ws(';', CASE WHEN n > 35 THEN 'long sentence' END, CASE WHEN depth >= 2 THEN 'nested clauses' END, CASE WHEN span > 5 THEN 'late verb' END, CASE WHEN rc >= 2 THEN 'relative clauses' END,
  CASE WHEN part > 0 THEN 'extended attribute' END, CASE WHEN vf > 5 THEN 'long first field' END) END AS factors FROM r"""),
    "risk_summary": (risk_summary, f"WITH {RISK} SELECT count(*) AS sentences, count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'medium') AS medium, count(*) FILTER (risk_level = 'low') AS low, max(depth)::INT AS max_depth FROM r"),
    "high_risk_top5": (high_risk_top5, f"WITH {RISK} SELECT doc_id, idx, n::INT AS n_tokens FROM r ORDER BY risk_score DESC, doc_id, idx LIMIT 5"),
    "changed_flags": (changed_flags, f"WITH {V.TRANSLATED} SELECT id, regexp_replace(mt, '^\\s+|\\s+$', '', 'g') <> regexp_replace(ref, '^\\s+|\\s+$', '', 'g') AS changed FROM translated"),
    "mt_updates": (mt_updates, f"WITH {V.PAIRS} SELECT id % 2 <> 0 AS open, count(*) AS n FROM pairs GROUP BY 1"),
    "text_search": (text_search, f"WITH {V.PAIRS} SELECT id FROM pairs WHERE src ILIKE '%tion%' OR ref ILIKE '%heed%'"),
    "json_answers": (json_answers, f"WITH {V.RATINGS} SELECT rating, count(*) AS n FROM ratings GROUP BY rating"),
    "numbered_answers": (numbered_answers, f"""WITH {SENTENCES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sentences)
SELECT doc_id, idx AS local, CASE WHEN n >= 0.8 * (n + 1) THEN sentence ELSE '[' || (idx + 1) || '] ' || sentence END AS text FROM n UNION ALL SELECT doc_id, count(*)::INT, '{B.UNPARSED}' FROM sentences GROUP BY doc_id"""),
    "edit_types": (edit_types, None),
    "provider_pipeline": (provider_pipeline, None),
    "prompts": (prompts, None),
    "report_rows": (report_rows, f"""WITH {REVIEW} SELECT ("index" // 100)::BIGINT AS block, row_number() OVER (PARTITION BY "index" // 100 ORDER BY "index") AS seg, upper(triage) AS label, length('EN: ' || final)::INT AS chars FROM review"""),
}
