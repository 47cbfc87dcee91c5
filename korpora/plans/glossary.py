"""Queries with a glossary as a table: the phrases of one to eight words of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.functions import text as X
from korpora.operators import glossary as G
from korpora.plans import views as V
from korpora.plans.terms import SENTENCES_SQL
from korpora.session import table

LONGEST = 8


def phrases(spark, d) -> DataFrame:
    """de, en: phrases of at least eight characters."""
    w = table(spark, d, "benchmark").select(X.words(F.lower("text")).alias("w"))
    at = w.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i")).filter("size(w) > 0").select("w", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size("w") - F.col("i") + 1))).alias("n"))
    de = at.select(F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("de")).filter("length(de) >= 8").distinct()
    return de.withColumn("en", F.regexp_replace("de", "e", "a"))


PHRASES = rf"""bw AS (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM benchmark), bi AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM bw), bn AS (SELECT w, i, unnest(range(1, least({LONGEST}, len(w) - i + 1) + 1)) AS n FROM bi),
terms AS (SELECT DISTINCT de, replace(de, 'e', 'a') AS en FROM (SELECT array_to_string(w[i:i + n - 1], ' ') AS de FROM bn) WHERE length(de) >= 8)"""


def table_topk(spark, d):
    return G.longest_matches(V.sentences(spark, d), phrases(spark, d))


def table_violations(spark, d):
    s = V.sentences(spark, d)
    mt = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.lower("sentence"), "e", "a")).otherwise(F.col("sentence"))
    return G.violations(s.select("doc_id", "idx", F.col("sentence").alias("src"), mt.alias("mt")), phrases(spark, d)).select("doc_id", "idx", F.array_join("violations", ";").alias("violations"))


def table_lookup(spark, d):
    return G.lookup(V.sentences(spark, d).filter("sentence IS NOT NULL"), phrases(spark, d))


QUERIES = {
    "glossary_table_topk": (table_topk, f"""WITH {SENTENCES_SQL}, {PHRASES}, p AS MATERIALIZED (SELECT doc_id, idx, lower(sentence) AS s FROM sentences), r AS (SELECT doc_id, idx, de, en, row_number() OVER (PARTITION BY doc_id, idx ORDER BY length(de) DESC, encode(de), encode(en)) AS rank FROM p JOIN terms ON contains(s, de))
SELECT doc_id, idx, de, en, rank::INT AS rank FROM r WHERE rank <= 5"""),
    "glossary_table_violations": (table_violations, f"""WITH {SENTENCES_SQL}, {PHRASES}, p AS MATERIALIZED (SELECT doc_id, idx, lower(sentence) AS s, CASE WHEN doc_id % 2 = 0 THEN replace(lower(sentence), 'e', 'a') ELSE lower(sentence) END AS mt FROM sentences)
SELECT doc_id, idx, string_agg(de || '=' || en, ';' ORDER BY encode(de || '=' || en)) AS violations FROM p JOIN terms ON contains(s, de) AND NOT contains(mt, en) GROUP BY doc_id, idx"""),
    "glossary_table_lookup": (table_lookup, None),
}
