"""Queries of review sessions, references and mined terms over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpora.functions import text as X
from korpora.operators import batching as B
from korpora.operators import corpus as C
from korpora.operators import terms as T
from korpora.operators import triage as Q
from korpora.plans import views as V
from korpora.plans.corpus import QUERIES as CORPUS
from korpora.plans.corpus import SPLIT, cooccurrence_terms
from korpora.plans.segments import review
from korpora.plans.terms import SENTENCES_SQL
from korpora.session import table

WHOLE_REVIEW = f"""{V.RATINGS}, review AS (SELECT d.doc_id AS "index", coalesce(rating, 'minor') AS rating, {V.BUCKET} AS triage, d.doc_id % 6 = 0 AS confirmed,
  CASE WHEN d.doc_id % 6 = 0 AND d.doc_id % 12 <> 0 THEN lower(d.text) ELSE d.text END AS final FROM documents d LEFT JOIN ratings r ON r."index" = d.doc_id)"""


def review_queue_whole(spark, d):
    return Q.review_view(review(spark, d), "needs_review").select("index", "rating", "triage", "final")


def review_red_whole(spark, d):
    return Q.review_view(review(spark, d), "red_only").select("index", "final", Q.colour(F.col("rating")).alias("colour"))


def term_clean_whole(spark, d):
    """Every sentence of every text as a candidate."""
    return V.sentences(spark, d).select("doc_id", "idx", C.clean_term(F.col("sentence")).alias("term")).filter("term IS NOT NULL")


def listed_terms_whole(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(X.listed(F.replace("text", F.lit(" "), F.lit("/")))).alias("part"))


def cooccurrence_ranked(spark, d):
    return T.by_strength(cooccurrence_terms(spark, d)).withColumns({"strength": F.round("strength", 6), "consistency": F.round("consistency", 6)})


def session_log(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.col("source"), F.col("text").alias("translation"))
    confirmed = docs.filter("index % 6 = 0").select("index", F.concat(F.col("translation"), F.lit(" ok")).alias("confirmed_text"))
    first = V.ratings(spark, d)
    rated = first.withColumn("at", F.lit(0)).unionByName(V.second_run(first).withColumn("at", F.lit(1)))
    return Q.session_log(docs, confirmed, rated, "at", "corpus")


def references_by_position(spark, d):
    s = V.sentences(spark, d)
    own = s.select((F.col("doc_id") + 1).alias("doc_id"), "idx", F.col("sentence").alias("mt"))
    return Q.with_reference(own, s.select("doc_id", "idx", F.col("sentence").alias("reference")), "doc_id", "idx")


def split_changed(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 500).alias("changed"))
    return C.split_changed(rows, "doc_id").select("doc_id", "split")


def within_ter(spark, d):
    rows = C.split_by_rank(table(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 100) / 100).alias("ter")), "doc_id")
    return C.within_ter(rows).select("doc_id", "split", "ter")


def qe_skipped(spark, d):
    return Q.unscored(table(spark, d, "documents").select("doc_id")).groupBy("score", "triage").agg(F.count("*").alias("n"))


def rule_proposals(spark, d):
    """Answers of three kinds over whole texts: fenced objects, objects in prose, prose only."""
    o = F.to_json(F.struct(F.concat(F.lit("rule_"), F.col("doc_id")).alias("rule_name"), F.lit("qe").alias("target_prompt"), F.lit("TERMS").alias("target_section"), F.col("text").alias("rule_text"), F.lit("major").alias("severity")))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), o, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here: "), o, F.lit(" Done."))).otherwise(F.lit("no object"))
    rows = table(spark, d, "documents").select("doc_id", answer.alias("response"), F.lit("terms").alias("type"))
    return B.parsed_proposals(rows, "doc_id")


HASH = "(doc_id * 2654435761 + 42) % 4294967296"
QUERIES = {
    "review_queue_whole": (review_queue_whole, f"""WITH {WHOLE_REVIEW} SELECT "index", rating, triage, final FROM review WHERE triage <> 'green' AND NOT confirmed"""),
    "review_red_whole": (review_red_whole, f"""WITH {WHOLE_REVIEW} SELECT "index", final, CASE rating WHEN 'good' THEN 'green' WHEN 'minor' THEN 'orange' ELSE 'red' END AS colour FROM review WHERE triage = 'red'"""),
    "term_clean_whole": (term_clean_whole, rf"""WITH {SENTENCES_SQL}, t AS (SELECT doc_id, idx, trim(regexp_replace(sentence, '\s+', ' ', 'g')) AS term FROM sentences)
SELECT doc_id, idx, term FROM t WHERE length(term) BETWEEN 2 AND 200 AND length(regexp_replace(term, '[^\p{{L}}]', '', 'g')) / length(term) >= 0.4"""),
    "listed_terms_whole": (listed_terms_whole, "SELECT item_id, part FROM (SELECT item_id, trim(unnest(string_split(replace(replace(text, ' ', '/'), '/', ','), ','))) AS part FROM benchmark) WHERE part <> ''"),
    "cooccurrence_ranked": (cooccurrence_ranked, f"SELECT term, partner, frequency, together, round(consistency, 6) AS consistency, round(frequency * consistency, 6) AS strength FROM ({CORPUS['cooccurrence_terms'][1]}) ORDER BY strength DESC, term, partner"),
    "session_log": (session_log, f"""WITH {V.RATINGS}, {V.SECOND}, twice AS (SELECT *, 0 AS run FROM ratings UNION ALL SELECT *, 1 FROM second), q AS (SELECT *, row_number() OVER (PARTITION BY "index" ORDER BY run DESC) AS k FROM twice)
SELECT d.doc_id AS "index", coalesce(d.source, '') AS source, coalesce(d.text, '') AS original, d.text || ' ok' AS final, coalesce(rating, 'unknown') AS qe_rating, coalesce(error_category, '') AS qe_category, 'corpus' AS document
FROM documents d LEFT JOIN q r ON r."index" = d.doc_id AND r.k = 1 WHERE d.doc_id % 6 = 0 AND d.text IS NOT NULL"""),
    "references_by_position": (references_by_position, f"WITH {SENTENCES_SQL} SELECT a.doc_id + 1 AS doc_id, a.idx, a.sentence AS mt, coalesce(b.sentence, '(no reference available)') AS reference FROM sentences a LEFT JOIN sentences b ON b.doc_id = a.doc_id + 1 AND b.idx = a.idx"),
    "split_changed": (split_changed, f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {HASH}, doc_id) <= greatest(1, count(*) OVER () // 10) THEN 'val' ELSE 'train' END AS split FROM documents WHERE n_chars > 500"),
    "within_ter": (within_ter, f"WITH {SPLIT}, a AS (SELECT doc_id, (n_chars % 100) / 100 AS ter, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r) SELECT doc_id, split, ter FROM a WHERE split = 'test' OR ter <= 0.5"),
    "qe_skipped": (qe_skipped, "SELECT 0.75::DOUBLE AS score, 'review' AS triage, count(*) AS n FROM documents"),
    "rule_proposals": (rule_proposals, """SELECT doc_id, 'rule_' || doc_id AS rule_name, 'qe' AS target_prompt, 'TERMS' AS target_section, text AS rule_text, 'major' AS severity, NULL::VARCHAR AS rationale, true AS parsed FROM documents WHERE doc_id % 3 <> 2
UNION ALL SELECT doc_id, 'auto_terms', 'qe', 'UNKNOWN', 'no object', 'minor', 'failed to parse the answer', false FROM documents WHERE doc_id % 3 = 2"""),
}
