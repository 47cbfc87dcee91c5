"""Queries of report rows and of corpora put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.functions import text as X
from korpora.operators import corpora as C
from korpora.operators import evaluation as Q
from korpora.operators import feedback as E
from korpora.operators import report as R
from korpora.plans import views as V
from korpora.plans.corpus import REASON
from korpora.plans.terms import SENTENCES_SQL
from korpora.session import table


def segments(spark, d) -> DataFrame:
    """Sentences as segments, with flags and four error spans that follow from their lengths."""
    n = F.length("sentence")
    start, size = (lambda k: (n * 7 + k * 13) % n), (lambda k: (n + k * 5) % 17)
    span = lambda k: F.struct(start(k).alias("start"), (start(k) + size(k)).alias("end"), F.substring("sentence", start(k) + 1, size(k)).alias("text"), F.get(F.array(*map(F.lit, R.SEVERITIES)), ((n + k) % 3).cast("int")).alias("severity"), ((n + k) % 10 / 10).alias("confidence"))
    score = n % 100 / 100
    return V.sentences(spark, d).select(
        "doc_id", "idx", F.col("sentence").alias("de"), F.replace("sentence", F.lit("e"), F.lit("E")).alias("ape"), F.lower("sentence").alias("deepl"), F.when(score >= 0.92, "PUBLISH").when(score >= 0.75, "REVIEW").otherwise("FULL_EDIT").alias("triage"), score.alias("score"),
        (n % 3 == 0).alias("changed"), (n % 5 == 0).alias("skipped"), (n % 4).alias("n_glossary"), F.filter(F.array(*map(span, range(4))), lambda s: s["confidence"] >= 0.35).alias("error_spans"),
    )


SPAN = "struct_pack(\"start\" := (n * 7 + {k} * 13) % n, \"end\" := (n * 7 + {k} * 13) % n + (n + {k} * 5) % 17, text := substr(sentence, (n * 7 + {k} * 13) % n + 1, (n + {k} * 5) % 17), severity := ['minor', 'major', 'critical'][(n + {k}) % 3 + 1], confidence := (n + {k}) % 10 / 10)"
SEGMENTS = f"""{SENTENCES_SQL}, sized AS (SELECT *, length(sentence) AS n FROM sentences), segments AS (SELECT doc_id, idx, sentence AS de, replace(sentence, 'e', 'E') AS ape, lower(sentence) AS deepl, n, CASE WHEN n % 100 >= 92 THEN 'PUBLISH' WHEN n % 100 >= 75 THEN 'REVIEW' ELSE 'FULL_EDIT' END AS triage, n % 100 / 100 AS score,
  n % 3 = 0 AS changed, n % 5 = 0 AS skipped, n % 4 AS n_glossary, list_filter([{", ".join(SPAN.format(k=k) for k in range(4))}], lambda s: s.confidence >= 0.35) AS spans FROM sized)"""


def annotated_report(spark, d):
    return R.report_lines(segments(spark, d), "doc_id", "idx")


def annotated_summary(spark, d):
    return R.report_summary(segments(spark, d))


def annotated_runs(spark, d):
    return R.annotated_runs(segments(spark, d), "de", "doc_id", "idx")


def neighbours(s):
    """Each element of an array with the next one; the last has none."""
    return F.when(F.size(s) > 1, F.arrays_zip(F.slice(s, 1, F.size(s) - 1).alias("src"), F.slice(s, 2, F.size(s) - 1).alias("ref")))


def corpora_concatenated(spark, d):
    """Each language is a corpus of a sentence and the next one; 300 usable pairs of each."""
    s = table(spark, d, "documents").select("doc_id", F.col("lang").alias("corpus"), X.once(X.sentences(F.col("text")), neighbours).alias("s"))
    pairs = s.select("corpus", "doc_id", F.posexplode("s").alias("idx", "p"))
    lines = pairs.select("corpus", (F.col("doc_id") * 1000000 + F.col("idx")).alias("line_no"), "p.src", "p.ref")
    return C.usable(lines, 300)


def feedback_report(spark, d):
    return E.report(V.feedback(spark, d), "event_id")


def corrected_where_needed(spark, d):
    rows = segments(spark, d).withColumn("translation", F.col("de")).withColumn("violations", F.when(F.col("n_glossary") == 3, F.array(F.lit("Nut=groove"))).otherwise(F.array().cast("array<string>")))
    fixed = Q.corrected_where_needed(rows.drop("ape", "changed", "skipped"), lambda x: x.withColumn("ape", F.when(F.col("score") < 0.9, F.replace("translation", F.lit("e"), F.lit("E")))), least=0.8)
    return fixed.select("doc_id", "idx", "ape", "changed", "skipped", F.size("real_errors").alias("n_errors"))


REPORT = f"""WITH {V.FEEDBACK}, h AS (SELECT count(*) AS n, count(*) FILTER (NOT changed) AS same, count(*) FILTER (changed) AS edited, count(*) FILTER (changed AND qe_rating = 'good') AS missed, count(*) FILTER (NOT changed AND qe_rating IN ('major', 'critical')) AS alarms FROM feedback),
l AS (SELECT [printf('Total confirmed segments: %d', n), printf('  Accepted as-is: %d', same), printf('  Edited before confirming: %d', edited), 'QE ACCURACY:', printf('  False negatives (QE said good, translator edited): %d', missed), printf('  False positives (QE flagged, translator accepted as-is): %d', alarms)] AS l FROM h),
e AS (SELECT *, row_number() OVER (PARTITION BY edit_type ORDER BY event_id) AS r FROM feedback WHERE changed), c AS (SELECT edit_type, count(*) AS n, count(*) FILTER (qe_rating <> 'good' AND r <= 15) * 100.0::DOUBLE / count(*) AS caught FROM e GROUP BY 1)
SELECT 0 AS part, unnest(range(len(l)))::INT AS k, unnest(l) AS line FROM l UNION ALL SELECT 1, (row_number() OVER (ORDER BY n DESC, edit_type))::INT, printf('  %s: %d', edit_type, n) FROM c
UNION ALL SELECT 2, (row_number() OVER (ORDER BY n DESC, edit_type))::INT, printf('  %s: %d occurrences — QE catches %.1f%% [%s]', edit_type, n, caught, CASE WHEN caught < 60 THEN 'NEEDS RULE' ELSE 'PARTIALLY COVERED' END) FROM c WHERE n >= 3"""

CORRECTED = f"""WITH {SEGMENTS}, r AS (SELECT doc_id, idx, de, score, len(list_filter(spans, lambda s: s.confidence >= 0.8)) AS n_errors, n_glossary = 3 AS violated FROM segments), a AS (SELECT *, n_errors = 0 AND NOT violated AS skipped FROM r),
f AS (SELECT *, CASE WHEN NOT skipped AND score < 0.9 THEN replace(de, 'e', 'E') ELSE de END AS ape FROM a) SELECT doc_id, idx, ape, ape <> de AS changed, skipped, n_errors::INT AS n_errors FROM f"""

CORPORA = f"""WITH {SENTENCES_SQL}, p AS (SELECT lang AS corpus, doc_id * 1000000 + idx AS line_no, sentence AS src, lead(sentence) OVER (PARTITION BY doc_id ORDER BY idx) AS ref FROM sentences), k AS (SELECT * FROM p WHERE ref IS NOT NULL AND {REASON} IS NULL)
SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY line_no) AS r FROM k) WHERE r <= 300"""

LINES = """'[' || doc_id || '.' || idx || '] ' || triage || printf(' (QE: %.3f)', score) || CASE WHEN skipped THEN '  • QE passthrough' WHEN changed THEN '  • APE corrected' ELSE '' END || CASE WHEN len(spans) > 0 THEN printf('  • %d errors detected', len(spans)) ELSE '' END
  || CASE WHEN n_glossary > 0 THEN printf('  • %d glossary terms', n_glossary) ELSE '' END, 'DE: ' || de, 'EN: ' || ape, CASE WHEN changed THEN 'DeepL original: ' || deepl END,
  CASE WHEN len(spans) > 0 THEN 'QE errors: ' || array_to_string(list_transform(spans, lambda e: '''' || e.text || ''' (' || e.severity || printf(', %.2f)', e.confidence)), ', ') END"""

RUNS = """s AS (SELECT doc_id, idx, n, unnest(spans) AS s FROM segments), c AS (SELECT doc_id, idx, least(s."start", n) AS a, least(s."end", n) AS b, s.severity AS severity FROM s), live AS (SELECT * FROM c WHERE a < b),
p AS (SELECT doc_id, idx, a AS pos FROM live UNION SELECT doc_id, idx, b FROM live UNION SELECT doc_id, idx, 0 FROM segments UNION SELECT doc_id, idx, n FROM segments), r AS (SELECT doc_id, idx, pos AS "start", lead(pos) OVER (PARTITION BY doc_id, idx ORDER BY pos) AS "end" FROM p),
o AS (SELECT r.doc_id, r.idx, r."start", r."end", max(CASE severity WHEN 'minor' THEN 1 WHEN 'major' THEN 2 WHEN 'critical' THEN 3 END) AS g FROM r LEFT JOIN live ON live.doc_id = r.doc_id AND live.idx = r.idx AND live.a <= r."start" AND live.b >= r."end" WHERE r."end" IS NOT NULL GROUP BY ALL),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR coalesce(g, 0) <> coalesce(lag(g) OVER w, 0) THEN 1 ELSE 0 END AS new FROM o WINDOW w AS (PARTITION BY doc_id, idx ORDER BY "start")), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, idx ORDER BY "start") AS run FROM f),
m AS (SELECT doc_id, idx, min("start") AS "start", max("end") AS "end", any_value(g) AS g FROM i GROUP BY doc_id, idx, run)"""

QUERIES = {
    "feedback_report": (feedback_report, REPORT),
    "corrected_where_needed": (corrected_where_needed, CORRECTED),
    "annotated_report": (annotated_report, f"WITH {SEGMENTS}, l AS (SELECT doc_id, idx, [{LINES}] AS l FROM segments) SELECT * FROM (SELECT doc_id, idx, unnest(range(5))::INT AS k, unnest(l) AS line FROM l) WHERE line IS NOT NULL"),
    "annotated_summary": (annotated_summary, f"""WITH {SEGMENTS} SELECT printf('Processed %d segments  |  Publish: %d (%d%%)  |  Review: %d (%d%%)  |  Full Edit: %d (%d%%)  |  APE Changed: %d (%d%%)  |  QE Passthrough: %d (%d%%)  |  Glossary forced: %d', count(*), {", ".join(f"count(*) FILTER ({c}), 100 * count(*) FILTER ({c}) // count(*)" for c in ("triage = 'PUBLISH'", "triage = 'REVIEW'", "triage = 'FULL_EDIT'", "changed", "skipped"))}, count(*) FILTER (n_glossary > 0)) AS line FROM segments"""),
    "annotated_runs": (annotated_runs, f"""WITH {SEGMENTS}, {RUNS} SELECT m.doc_id, m.idx, m."start"::INT AS "start", m."end"::INT AS "end", CASE m.g WHEN 1 THEN 'minor' WHEN 2 THEN 'major' WHEN 3 THEN 'critical' END AS severity, substr(de, m."start" + 1, m."end" - m."start") AS run FROM m JOIN segments USING (doc_id, idx)"""),
    "corpora_concatenated": (corpora_concatenated, CORPORA),
}
