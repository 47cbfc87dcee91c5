"""The driver's tables in the roles of the engine's tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.functions import text as X
from korpora.session import table

GLOSSARY = [("ung", "ing"), ("lich", "ly"), ("keit", "ness"), ("heit", "hood"), ("sch", "sh"), ("ver", "for"), ("einung", "union")]


def sql_list(entries: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in entries)


def pairs(spark, d) -> DataFrame:
    """id, src, ref: a user's turn and the assistant's next."""
    c = table(spark, d, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("src"))
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("ref"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("id"), "src", "ref")


PAIRS = """pairs AS (SELECT u.conv_id * 1000 + u.turn AS id, u.text AS src, a.text AS ref FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def translated(spark, d) -> DataFrame:
    """pairs with mt, a variant of the reference."""
    return pairs(spark, d).withColumn("mt", F.regexp_replace(F.regexp_replace("ref", " of ", " from "), " and ", " plus "))


TRANSLATED = PAIRS + """, translated AS (SELECT *, replace(replace(ref, ' of ', ' from '), ' and ', ' plus ') AS mt FROM pairs)"""


def ratings(spark, d) -> DataFrame:
    """index, rating, confidence, error_category, risk_level from the labels."""
    x = F.col("doc_id")
    rating = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "good").when(F.col("quality") == 1, "minor").when(F.col("toxic") == 0, "major").otherwise("critical")
    pick = lambda n, *names: F.get(F.array(*[F.lit(v) for v in names]), (x % n).cast("int"))
    return table(spark, d, "labels").select(
        x.alias("index"), rating.alias("rating"), pick(5, "high", "medium", "low", None, "unsure").alias("confidence"),
        pick(7, "terminology", "reordering", "omission", "grammar", "addition", "other", "none").alias("error_category"), pick(3, "high", "medium", "low").alias("risk_level"),
    )


RATINGS = """ratings AS (SELECT doc_id AS "index", CASE WHEN quality = 1 AND toxic = 0 THEN 'good' WHEN quality = 1 THEN 'minor' WHEN toxic = 0 THEN 'major' ELSE 'critical' END AS rating,
  ['high', 'medium', 'low', NULL, 'unsure'][doc_id % 5 + 1] AS confidence, ['terminology', 'reordering', 'omission', 'grammar', 'addition', 'other', 'none'][doc_id % 7 + 1] AS error_category,
  ['high', 'medium', 'low'][doc_id % 3 + 1] AS risk_level FROM labels)"""
BUCKET = """CASE WHEN coalesce(rating, 'minor') = 'good' AND coalesce(confidence, 'medium') IN ('high', 'medium') THEN 'green' WHEN coalesce(rating, 'minor') = 'good' AND confidence = 'low' THEN 'orange'
  WHEN coalesce(rating, 'minor') = 'minor' THEN 'orange' ELSE 'red' END"""


def second_run(r: DataFrame) -> DataFrame:
    """Another run over most of the indexes, every fourth rating milder."""
    milder = F.when(F.col("index") % 4 == 0, F.when(F.col("rating") == "critical", "major").when(F.col("rating") == "major", "minor").otherwise("good")).when(F.col("index") % 9 == 0, "major").otherwise(F.col("rating"))
    return r.filter("index % 11 <> 0").withColumn("rating", milder)


SECOND = """second AS (SELECT "index", CASE WHEN "index" % 4 = 0 THEN CASE rating WHEN 'critical' THEN 'major' WHEN 'major' THEN 'minor' ELSE 'good' END WHEN "index" % 9 = 0 THEN 'major' ELSE rating END AS rating,
  confidence, error_category, risk_level FROM ratings WHERE "index" % 11 <> 0)"""


def feedback(spark, d) -> DataFrame:
    """event_id, changed, qe_rating, edit_type, code, ts from the event log."""
    e = table(spark, d, "events")
    pick = F.get(F.array(*map(F.lit, ("good", "minor", "major", "critical"))), (F.col("event_id") % 4).cast("int"))
    return e.select("event_id", (F.col("value") > 50).alias("changed"), pick.alias("qe_rating"), F.col("event_type").alias("edit_type"), F.col("user_id").alias("code"), "ts")


FEEDBACK = """feedback AS (SELECT event_id, value > 50 AS changed, ['good', 'minor', 'major', 'critical'][event_id % 4 + 1] AS qe_rating, event_type AS edit_type, user_id AS code, ts FROM events)"""


def sentences(spark, d) -> DataFrame:
    return X.split_sentences(table(spark, d, "documents"))


def german_tokens(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter("lang = 'de'").select(F.explode(X.words(F.lower("text"))).alias("token"))


GERMAN = r"""tokens AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS token FROM documents WHERE lang = 'de')"""


def stripped_sql(word: str, endings: tuple[str, ...], stem: int) -> str:
    return "CASE " + " ".join(f"WHEN suffix({word}, '{s}') AND length({word}) > {len(s) + stem} THEN substr({word}, 1, length({word}) - {len(s)})" for s in endings) + f" ELSE {word} END"


LENGTHS = "(doc_id * 2654435761 + {seed}) % 4294967296"
