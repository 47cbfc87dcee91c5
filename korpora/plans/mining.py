"""Queries that mine terms and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.functions import lexicons as W
from korpora.operators import mining as M
from korpora.plans import views as V

#: What the machine writes for words of the reference.
SLIPS = (("avec", "alongside"), ("dans", "within"), ("une", "oneself"), ("nicht", "never"), ("sich", "itself"), ("los", "thosewho"), ("las", "leadplug"), ("del", "delfrom"), ("thing", "thong"), ("tion", "tension"))


def machine(spark, d) -> DataFrame:
    """id, src, ref and mt: the reference with slips, and two words swapped in every third text."""
    mt = F.col("ref")
    for right, wrong in SLIPS:
        mt = F.replace(mt, F.lit(f" {right} "), F.lit(f" {wrong} "))
    return V.pairs(spark, d).withColumn("mt", F.when(F.col("id") % 3 == 0, F.replace(mt, F.lit(" de la "), F.lit(" la de "))).otherwise(mt))


def slipped(text: str) -> str:
    for right, wrong in SLIPS:
        text = f"replace({text}, ' {right} ', ' {wrong} ')"
    return text


MACHINE = f"{V.PAIRS}, m0 AS (SELECT *, {slipped('ref')} AS m FROM pairs), machine AS (SELECT id, src, ref, CASE WHEN id % 3 = 0 THEN replace(m, ' de la ', ' la de ') ELSE m END AS mt FROM m0)"


def mined_term_pairs(spark, d):
    return M.term_pairs(V.pairs(spark, d), min_frequency=5, min_consistency=0.5, sizes=(3, 200))


def mined_correction_triples(spark, d):
    return M.correction_triples(machine(spark, d))


def mined_bigram_corrections(spark, d):
    return M.bigram_corrections(machine(spark, d), most=30)


def listed(entries: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in entries) + "]"


WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+'))"
NUMBER = r"regexp_full_match({0}, '\p{{Nd}}+')"


def minus(words: str, *lists: str) -> str:
    return f"list_filter({words}, lambda x: " + " AND ".join(f"NOT list_contains({x}, x)" for x in lists) + ")"


TERM_PAIRS = f"""WITH {V.PAIRS}, s AS (SELECT {minus(WORDS.format("src"), listed(W.GERMAN_TERM_STOPWORDS))} AS s, {minus(WORDS.format("ref"), listed(W.ENGLISH_TERM_STOPWORDS))} AS t FROM pairs),
k AS (SELECT * FROM s WHERE len(s) BETWEEN 3 AND 200 AND len(t) BETWEEN 3 AND 200), one AS (SELECT unnest(list_filter(s, lambda x: length(x) >= 4)) AS de_term, list_filter(t, lambda x: length(x) >= 3) AS t FROM k),
f AS (SELECT de_term, count(*) AS frequency FROM one GROUP BY 1 HAVING count(*) >= 5), c AS (SELECT de_term, en_term, count(*) AS n FROM (SELECT de_term, unnest(t) AS en_term FROM one) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY de_term ORDER BY n DESC, encode(en_term)) AS k FROM f JOIN c USING (de_term))
SELECT de_term, en_term, frequency, n / frequency AS consistency FROM b WHERE k = 1 AND n / frequency >= 0.5 AND de_term <> en_term AND NOT {NUMBER.format("de_term")} AND NOT {NUMBER.format("en_term")}"""

TRIPLES = f"""WITH {MACHINE}, w AS (SELECT id, {WORDS.format("mt")} AS m, {WORDS.format("ref")} AS r, {minus(WORDS.format("src"), listed(W.GERMAN_STOPWORDS))} AS s FROM machine),
d AS (SELECT id, list_filter({minus("m", "r", listed(W.ENGLISH_STOPWORDS))}, lambda x: length(x) >= 3 AND NOT {NUMBER.format("x")}) AS gone, list_filter({minus("r", "m", listed(W.ENGLISH_STOPWORDS))}, lambda x: length(x) >= 3 AND NOT {NUMBER.format("x")}) AS new,
  list_filter(s, lambda x: length(x) >= 4) AS s FROM w), k AS (SELECT * FROM d WHERE len(gone) <= 15 AND len(new) <= 15),
one AS (SELECT id, unnest(gone) AS en_mt_error, new, s FROM k), total AS (SELECT en_mt_error, count(*) AS total FROM one GROUP BY 1), two AS (SELECT id, en_mt_error, unnest(new) AS en_correct, s FROM one),
good AS (SELECT en_mt_error, en_correct, count(*) AS frequency, count(*) / any_value(total) AS consistency FROM two JOIN total USING (en_mt_error) GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) / any_value(total) >= 0.5),
c AS (SELECT en_mt_error, en_correct, de_term, count(*) AS n FROM (SELECT en_mt_error, en_correct, unnest(s) AS de_term FROM two SEMI JOIN good USING (en_mt_error, en_correct)) GROUP BY ALL),
r AS (SELECT *, n / frequency AS de_association, row_number() OVER (PARTITION BY en_mt_error, en_correct ORDER BY n DESC, encode(de_term)) AS k FROM c JOIN good USING (en_mt_error, en_correct)),
p AS (SELECT *, row_number() OVER (PARTITION BY en_mt_error, en_correct ORDER BY k) AS first FROM r WHERE k <= 5 AND (k = 1 AND de_association >= 0.3 OR length(de_term) >= 5 AND de_association >= 0.15)),
u AS (SELECT *, row_number() OVER (PARTITION BY de_term ORDER BY frequency DESC, consistency DESC, encode(en_mt_error), encode(en_correct)) AS strongest FROM p WHERE first = 1)
SELECT de_term, en_correct, en_mt_error, frequency, consistency, de_association FROM u WHERE strongest = 1"""

GRAMS = r"list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
BIGRAMS = f"""WITH {MACHINE}, w AS (SELECT regexp_extract_all(lower(mt), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS m, regexp_extract_all(lower(ref), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS r FROM machine), g AS (SELECT {GRAMS.format("m")} AS m, {GRAMS.format("r")} AS r FROM w),
stops AS (SELECT {listed(W.ENGLISH_STOPWORDS)} AS stop), d AS (SELECT list_filter(m, lambda x: NOT list_contains(r, x) AND NOT (list_contains(stop, split_part(x, ' ', 1)) AND list_contains(stop, split_part(x, ' ', 2)))) AS gone,
  list_filter(r, lambda x: NOT list_contains(m, x) AND NOT (list_contains(stop, split_part(x, ' ', 1)) AND list_contains(stop, split_part(x, ' ', 2)))) AS new FROM g, stops),
one AS (SELECT unnest(gone) AS mt_bigram, new FROM d WHERE len(gone) <= 30 AND len(new) <= 30), t AS (SELECT mt_bigram, count(*) AS total FROM one GROUP BY 1 HAVING count(*) >= 5),
c AS (SELECT mt_bigram, ref_bigram, count(*) AS frequency FROM (SELECT mt_bigram, unnest(new) AS ref_bigram FROM one) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY mt_bigram ORDER BY frequency DESC, encode(ref_bigram)) AS k FROM t JOIN c USING (mt_bigram))
SELECT mt_bigram, ref_bigram, frequency, frequency / total AS consistency FROM b WHERE k = 1 AND frequency >= 3 AND frequency / total >= 0.4"""

QUERIES = {
    "mined_term_pairs": (mined_term_pairs, TERM_PAIRS),
    "mined_correction_triples": (mined_correction_triples, TRIPLES),
    "mined_bigram_corrections": (mined_bigram_corrections, BIGRAMS),
}
