"""Term scanning over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.functions import lexicons as W
from korpora.functions import text as X
from korpora.operators import terms as T
from korpora.session import table

SENTENCES_SQL = r"""
docs AS (SELECT doc_id, lang, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t FROM documents),
parts AS (SELECT doc_id, lang, string_split(regexp_replace(t, '([.!?])[ \t\n\x0b\f\r]+([A-ZÄÖÜ\[(])', '\1' || chr(30) || '\2', 'g'), chr(30)) AS s FROM docs),
kept AS (SELECT doc_id, lang, list_filter(list_transform(s, lambda x: trim(x)), lambda x: length(x) > 15) AS s FROM parts),
sentences AS (SELECT doc_id, lang, unnest(range(len(s)))::INT AS idx, unnest(s) AS sentence FROM kept)"""


def sentence_split(spark, d) -> DataFrame:
    return X.split_sentences(table(spark, d, "documents"))


def noun_counts(sentences: DataFrame, min_mid: int = 1, min_total: int = 8, min_initial: int = 5, stop: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> DataFrame:
    """Capitalised words: kept if seen inside a sentence, or often at its start. Words of ``stop`` in any case, and of ``skip`` as they are, don't count. Column ``sentence``."""
    tokens = sentences.select(F.posexplode(X.words(F.col("sentence"))).alias("pos", "token"))
    first = F.substring("token", 1, 1)
    noun = (
        (F.length("token") >= 2)
        & (first == F.upper(first))
        & (first != F.lower(first))
        & ~((F.col("token") == F.upper("token")) & (F.length("token") <= 4))
        & ~F.col("token").rlike("[0-9]")
    )
    if stop:
        noun = noun & ~F.lower("token").isin(*sorted({w.lower() for w in stop}))
    if skip:
        noun = noun & ~F.col("token").isin(*skip)
    return (
        tokens.filter(noun)
        .groupBy("token")
        .agg(F.count("*").alias("total"), F.count_if(F.col("pos") == 0).alias("initial"), F.count_if(F.col("pos") > 0).alias("mid"))
        .filter((F.col("mid") >= min_mid) | ((F.col("total") >= min_total) & (F.col("initial") >= min_initial)))
    )


def noun_candidates(spark, d) -> DataFrame:
    return noun_counts(sentence_split(spark, d))


def noun_candidates_listed(spark, d) -> DataFrame:
    return noun_counts(sentence_split(spark, d), stop=W.FUNCTION_WORDS + W.ENGLISH_FUNCTION_WORDS, skip=W.SKIP_TOKENS)


def technical_adjectives_listed(spark, d) -> DataFrame:
    tokens = table(spark, d, "documents").select(F.explode(X.words(F.lower("text"))).alias("token"))
    return T.technical_adjectives(tokens, W.TECHNICAL_SUFFIXES + ("lich", "heit")).withColumn("variants", F.array_join("variants", ","))


NOUN_SQL = f"""WITH {SENTENCES_SQL},
toks AS (SELECT regexp_extract_all(sentence, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS w FROM sentences),
t AS (SELECT unnest(range(len(w))) AS pos, unnest(w) AS token FROM toks)
SELECT * FROM (SELECT token, count(*) AS total, count(*) FILTER (pos = 0) AS initial, count(*) FILTER (pos > 0) AS mid FROM t
WHERE length(token) >= 2 AND token[1] = upper(token[1]) AND token[1] <> lower(token[1])
  AND NOT (token = upper(token) AND length(token) <= 4) AND NOT regexp_matches(token, '[0-9]')
GROUP BY token) WHERE mid >= 1 OR (total >= 8 AND initial >= 5)"""

def listed(entries) -> str:
    return ", ".join(f"'{w}'" for w in entries)


LISTED_SQL = NOUN_SQL.replace("GROUP BY token)", f"AND lower(token) NOT IN ({listed(w.lower() for w in W.FUNCTION_WORDS + W.ENGLISH_FUNCTION_WORDS)}) AND token NOT IN ({listed(W.SKIP_TOKENS)}) GROUP BY token)")
BASE_SQL = "CASE " + " ".join(f"WHEN suffix(token, '{s}') AND length(token) > {len(s) + 4} THEN substr(token, 1, length(token) - {len(s)})" for s in T.ADJECTIVE_ENDINGS) + " ELSE token END"
ADJECTIVE_SQL = f"""WITH s AS (SELECT unnest([{listed(W.TECHNICAL_SUFFIXES + ("lich", "heit"))}]) AS s), o AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS token FROM documents),
t AS (SELECT token, count(*) AS n, {BASE_SQL} AS base FROM o WHERE length(token) >= 6 AND token NOT IN ({listed(W.COMMON_VERBS + W.ADVERBS)}) GROUP BY token HAVING count(*) >= 2),
k AS (SELECT * FROM t WHERE EXISTS (SELECT 1 FROM s WHERE suffix(token, s) AND length(token) > length(s) + 2 OR suffix(base, s) AND length(base) > length(s) + 2))
SELECT base, sum(n)::BIGINT AS frequency, coalesce(string_agg(token, ',' ORDER BY encode(token)) FILTER (token <> base), '') AS variants FROM k GROUP BY base"""

QUERIES = {
    "noun_candidates_listed": (noun_candidates_listed, LISTED_SQL),
    "technical_adjectives_listed": (technical_adjectives_listed, ADJECTIVE_SQL),
    "sentence_split": (sentence_split, f"WITH {SENTENCES_SQL} SELECT doc_id, idx, sentence FROM sentences"),
    "noun_candidates": (noun_candidates, NOUN_SQL),
}
