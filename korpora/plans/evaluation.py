"""Queries of evaluation, sentence variants and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpora.functions import lexicons as W
from korpora.functions import text as X
from korpora.operators import corpus as C
from korpora.operators import evaluation as E
from korpora.operators import terms as T
from korpora.plans import views as V
from korpora.plans.corpus import QUERIES as CORPUS
from korpora.plans.corpus import SPLIT
from korpora.plans.terms import SENTENCES_SQL
from korpora.session import table


def variant(spark, d, make):
    return table(spark, d, "documents").select("doc_id", F.posexplode(make(F.col("text"))).alias("idx", "sentence"))


def sentence_split_protected(spark, d):
    return variant(spark, d, lambda t: X.guarded_sentences(t, W.ABBREVIATIONS))


def sentence_split_legal(spark, d):
    return variant(spark, d, lambda t: X.guarded_sentences(t, W.ABBREVIATIONS + W.ENGLISH_ABBREVIATIONS))


def sentence_split_markers(spark, d):
    return variant(spark, d, lambda t: X.guarded_sentences(t, W.ABBREVIATIONS, markers=True))


def sentence_extract(spark, d):
    return variant(spark, d, lambda t: X.paragraph_sentences(t, W.TERM_ABBREVIATIONS))


def protected_sql(text: str, abbreviations: tuple[str, ...]) -> str:
    for a in abbreviations:
        text = f"replace({text}, '{a}', '{a.replace('.', X.STOP)}')"
    return text


def split_sql(abbreviations: tuple[str, ...]) -> str:
    return rf"""WITH d AS (SELECT doc_id, {protected_sql("trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'))", abbreviations)} AS t FROM documents),
p AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])[ \t\n\x0b\f\r]+([A-ZÄÖÜ\[(])', '\1' || chr(30) || '\2', 'g'), chr(30)) AS s FROM d),
k AS (SELECT doc_id, list_filter(list_transform(s, lambda x: trim(replace(x, '{X.STOP}', '.'))), lambda x: length(x) > 15) AS s FROM p)
SELECT doc_id, unnest(range(len(s)))::INT AS idx, unnest(s) AS sentence FROM k"""


EXTRACT = rf"""WITH d AS (SELECT doc_id, {protected_sql("regexp_replace(text, '^\\[[0-9]{{4}}\\]\\s*', '')".replace("{{", "{").replace("}}", "}"), W.TERM_ABBREVIATIONS)} AS t FROM documents),
p AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])[ \t\n\x0b\f\r]+([A-ZÄÖÜ])', '\1' || chr(30) || '\2', 'g'), chr(30)) AS s FROM d),
k AS (SELECT doc_id, list_filter(list_transform(s, lambda x: replace(x, '{X.STOP}', '.')), lambda x: length(x) > 10) AS s FROM p)
SELECT doc_id, unnest(range(len(s)))::INT AS idx, unnest(s) AS sentence FROM k"""


def markers_sql() -> str:
    """Markers may follow each other, and the pattern takes in the character before: two passes find all."""
    letter, roman = r"(^|[^\p{L}\p{M}\p{N}_])([a-zA-Z0-9])\.[ \t\n\x0b\f\r]", r"(?i)(^|[^\p{L}\p{M}\p{N}_])(ii|iii|iv|vi|vii|viii|ix|xi|xii)\.[ \t\n\x0b\f\r]"
    text = "t"
    for p in (letter, letter, roman, roman):
        text = f"regexp_replace({text}, '{p}', '\\1\\2{X.STOP} ', 'g')"
    text = f"regexp_replace({text}, ':[ \\t\\n\\x0b\\f\\r]+([a-zA-Z0-9])\\.[ \\t\\n\\x0b\\f\\r]', ': \\1{X.STOP} ', 'g')"
    return split_sql(W.ABBREVIATIONS).replace(" AS t FROM documents),", f" AS t FROM documents), m AS (SELECT doc_id, {text} AS t FROM d),", 1).replace("chr(30)) AS s FROM d)", "chr(30)) AS s FROM m)", 1)


def domain_mapping(spark, d):
    from korpora.sources.readers import domain_of

    subject = F.get(F.array(*[F.lit(x) for x in ("Medical science", "Electronics", "Trade law", "Poetry")]), (F.col("doc_id") % 4).cast("int"))
    return table(spark, d, "documents").groupBy(domain_of(subject).alias("domain")).agg(F.count("*").alias("n"))


def medical_filter(spark, d):
    """Pairs with any of the stems, once each."""
    return V.pairs(spark, d).filter(F.lower("ref").rlike("|".join(W.MEDICAL_STEMS + ("tion of",)))).select("id")


def technical_terms(spark, d):
    tokens = V.german_tokens(spark, d).filter(~F.col("token").isin(*W.ADVERBS))
    return T.suffix_terms(tokens, W.TECHNICAL_SUFFIXES + ("lich", "heit"), least=1).withColumn("variants", F.array_join("variants", ","))


def error_routing(spark, d):
    """Segments by whether they go on to correction; spans drawn from sentence lengths."""
    n = F.length("sentence")
    span = lambda k: F.struct(F.substring("sentence", 1, 5).alias("text"), F.lit("minor").alias("severity"), ((n % k) / k).alias("confidence"))
    s = V.sentences(spark, d).select("doc_id", "idx", F.array(span(7), span(11)).alias("error_spans"), F.when(n % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("violations"))
    return E.routed(s).groupBy("skipped").agg(F.count("*").alias("n"), F.sum(F.size("real_errors")).alias("spans"))


def preference_summary(spark, d):
    r = V.ratings(spark, d)
    pick = F.get(F.array(F.lit("A"), F.lit("B"), F.lit("same"), F.lit(None)), (F.col("index") % 4).cast("int"))
    return E.preferences(r.select(pick.alias("preferred"), (F.col("index") % 6).alias("edits_a"), (F.col("index") % 5).alias("edits_b")))


def term_adherence(spark, d):
    r = V.ratings(spark, d)
    return r.groupBy("risk_level").agg(E.adherence(F.get(F.array(F.lit("yes"), F.lit("no"), F.lit("NA")), (F.col("index") % 3 + F.col("index") % 2).cast("int") % 3)).alias("adherence"))


def score_histogram(spark, d):
    return E.histogram(table(spark, d, "lineitem"), F.col("l_discount") * 10)


def random_documents(spark, d):
    return E.random_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


def term_dropout(spark, d):
    return table(spark, d, "documents").groupBy(E.dropout(F.col("doc_id"), 0.25).alias("dropped")).agg(F.count("*").alias("n"))


def next_unevaluated(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("index"))
    return E.next_open(docs, docs.filter("index < 17 OR index % 2 = 0"))


def experiments(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", (F.length("text") % 40).cast("double").alias("bleu"), (F.col("item_id") % 3 * 10).cast("double").alias("baseline"))
    return E.experiment_deltas(rows)


def reliabilities(spark, d):
    t = T.cooccurrence(V.pairs(spark, d), ("the", "of"), min_count=3, min_consistency=0.3)
    return t.groupBy(E.reliability(F.col("consistency")).alias("reliability")).agg(F.count("*").alias("n"))


def split_carved(spark, d):
    rows = C.split_by_rank(table(spark, d, "documents").select("doc_id"), "doc_id", (0.9, 0.05))
    return E.carve_validation(rows, "doc_id", take=100).groupBy("split").agg(F.count("*").alias("n"))


def proposals_decided(spark, d):
    p = table(spark, d, "benchmark").select(F.concat(F.lit("r"), "item_id").alias("rule_name"), F.when(F.col("item_id") % 5 == 0, "applied").otherwise("pending").alias("status"))
    dec = p.filter("rule_name LIKE '%3' OR rule_name LIKE '%0'").select("rule_name", F.when(F.col("rule_name").endswith("3"), "approved").otherwise("rejected").alias("status"))
    return E.decide(p, dec, F.lit("2024-01-01")).select("rule_name", "status", "decided_at")


def conditional_counts(spark, d):
    t = table(spark, d, "documents")
    return t.agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") > 1000).alias("long"), F.count_if(F.col("text").contains("#")).alias("marked"), F.countDistinct("source").alias("sources"), F.count_if(F.col("lang").isNull()).alias("no_lang"))


def term_hints(spark, d):
    s = table(spark, d, "documents").filter("lang = 'de'")
    pairs = F.filter(F.array(*[F.struct(F.lit(a).alias("de"), F.lit(b).alias("en")) for a, b in V.GLOSSARY]), lambda g: F.lower("text").contains(g["de"]))
    return s.select("doc_id", X.term_hint(pairs).alias("hint"))


COOCCURRENCE = CORPUS["cooccurrence_terms"][1]
HASH = "({0} * 2654435761 + 42) % 4294967296"
QUERIES = {
    "sentence_split_protected": (sentence_split_protected, split_sql(W.ABBREVIATIONS)),
    "sentence_split_legal": (sentence_split_legal, split_sql(W.ABBREVIATIONS + W.ENGLISH_ABBREVIATIONS)),
    "sentence_split_markers": (sentence_split_markers, markers_sql()),
    "sentence_extract": (sentence_extract, EXTRACT),
    "domain_mapping": (domain_mapping, "SELECT ['patent', 'technical', 'legal', 'general'][doc_id % 4 + 1] AS domain, count(*) AS n FROM documents GROUP BY 1"),
    "medical_filter": (medical_filter, f"WITH {V.PAIRS} SELECT id FROM pairs WHERE regexp_matches(lower(ref), '{'|'.join(W.MEDICAL_STEMS + ('tion of',))}')"),
    "technical_terms": (technical_terms, f"""WITH {V.GERMAN}, t AS (SELECT token, count(*) AS n, {V.stripped_sql('token', T.ADJECTIVE_ENDINGS, 4)} AS base FROM tokens WHERE length(token) >= 6 AND token NOT IN ({", ".join(f"'{a}'" for a in W.ADVERBS)}) GROUP BY token)
SELECT base, sum(n)::BIGINT AS frequency, array_to_string(list_sort(list(DISTINCT token)), ',') AS variants FROM t WHERE regexp_matches(token, '({"|".join(W.TECHNICAL_SUFFIXES + ("lich", "heit"))})$') OR regexp_matches(base, '({"|".join(W.TECHNICAL_SUFFIXES + ("lich", "heit"))})$') GROUP BY base"""),
    "error_routing": (error_routing, f"WITH {SENTENCES_SQL}, r AS (SELECT (length(sentence) % 7 / 7 >= 0.35)::INT + (length(sentence) % 11 / 11 >= 0.35)::INT AS k, length(sentence) % 5 = 0 AS v FROM sentences) SELECT k = 0 AND NOT v AS skipped, count(*) AS n, sum(k)::BIGINT AS spans FROM r GROUP BY 1"),
    "preference_summary": (preference_summary, f"""WITH {V.RATINGS}, p AS (SELECT ['A', 'B', 'same', NULL]["index" % 4 + 1] AS preferred, "index" % 6 AS a, "index" % 5 AS b FROM ratings) SELECT count(*) AS evaluated, 100.0::DOUBLE * count(*) FILTER (preferred = 'A') / count(preferred) AS prefer_a,
  100.0::DOUBLE * count(*) FILTER (preferred = 'B') / count(preferred) AS prefer_b, 100.0::DOUBLE * count(*) FILTER (preferred = 'same') / count(preferred) AS no_preference, avg(a) AS mean_a, avg(b) AS mean_b, 100.0::DOUBLE * (avg(a) - avg(b)) / greatest(0.01, avg(a)) AS reduction_pct FROM p"""),
    "term_adherence": (term_adherence, f"""WITH {V.RATINGS}, a AS (SELECT risk_level, ("index" % 3 + "index" % 2) % 3 AS k FROM ratings) SELECT risk_level, 100.0::DOUBLE * count(*) FILTER (k = 0) / nullif(count(*) FILTER (k < 2), 0) AS adherence FROM a GROUP BY 1"""),
    "score_histogram": (score_histogram, "SELECT round_even(l_discount * 10, 1) AS bin, count(*) AS n FROM lineitem GROUP BY 1"),
    "random_documents": (random_documents, f"SELECT doc_id FROM documents ORDER BY {HASH.format('doc_id')}, doc_id LIMIT 50"),
    "term_dropout": (term_dropout, f"SELECT {HASH.format('doc_id')} < 1073741824 AS dropped, count(*) AS n FROM documents GROUP BY 1"),
    "next_unevaluated": (next_unevaluated, "SELECT min(doc_id) AS next FROM documents WHERE NOT (doc_id < 17 OR doc_id % 2 = 0)"),
    "experiments": (experiments, "SELECT item_id, (length(text) % 40)::DOUBLE AS bleu, (item_id % 3 * 10)::DOUBLE AS baseline, CASE WHEN item_id % 3 <> 0 THEN (length(text) % 40)::DOUBLE - (item_id % 3 * 10) END AS delta FROM benchmark"),
    "proposals_decided": (proposals_decided, """SELECT 'r' || item_id AS rule_name, CASE WHEN item_id % 5 = 0 THEN 'applied' WHEN item_id % 10 = 3 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN item_id % 10 = 3 THEN '2024-01-01' END AS decided_at FROM benchmark"""),
    "conditional_counts": (conditional_counts, "SELECT count(*) AS total, count(*) FILTER (n_chars > 1000) AS long, count(*) FILTER (contains(text, '#')) AS marked, count(DISTINCT source) AS sources, count(*) FILTER (lang IS NULL) AS no_lang FROM documents"),
    "term_hints": (term_hints, f"""WITH g(k, de, en) AS (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(V.GLOSSARY))}) SELECT doc_id, coalesce(' || terms: ' || string_agg(de || '=' || en, '; ' ORDER BY k), '') AS hint FROM (SELECT * FROM documents WHERE lang = 'de') LEFT JOIN g ON contains(lower(text), de) GROUP BY doc_id"""),
    "reliabilities": (reliabilities, f"SELECT CASE WHEN consistency > 0.8 THEN 5 ELSE 3 END AS reliability, count(*) AS n FROM ({COOCCURRENCE}) GROUP BY 1"),
    "split_carved": (split_carved, f"""WITH {SPLIT}, a AS (SELECT doc_id, CASE WHEN k <= floor(n * 0.9) THEN 'train' WHEN k <= floor(n * 0.9) + floor(n * 0.05) THEN 'val' ELSE 'test' END AS split FROM r), c AS (SELECT count(*) FILTER (split = 'val') AS v, count(*) FILTER (split = 'train') AS t FROM a),
m AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS k FROM a) SELECT CASE WHEN split = 'train' AND k <= 100 AND v < 100 AND t > 100 THEN 'val' ELSE split END AS split, count(*) AS n FROM m, c GROUP BY 1"""),
}
