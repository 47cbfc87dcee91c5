"""Queries over the parallel corpus and the terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpora.functions import metrics as M
from korpora.functions import text as X
from korpora.operators import corpus as C
from korpora.operators import terms as T
from korpora.plans import views as V
from korpora.plans.terms import SENTENCES_SQL
from korpora.session import table

L = r"[^a-zA-ZäöüÄÖÜß]"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
S, R = STRIP.format("src"), STRIP.format("ref")
REASON = rf"""CASE WHEN {S} = '' OR {R} = '' THEN 'empty' WHEN length({S}) < 10 OR length({R}) < 10 THEN 'too_short' WHEN length({S}) > 500 OR length({R}) > 500 THEN 'too_long'
  WHEN length(regexp_replace({S}, '{L}', '', 'g')) / length({S}) < 0.4 THEN 'mostly_numbers' WHEN lower({S}) = lower({R}) THEN 'identical'
  WHEN length({S}) / length({R}) > 3.0 OR length({S}) / length({R}) < 0.3 THEN 'length_ratio' END"""
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"


def reasoned(spark, d):
    return V.pairs(spark, d).withColumn("reject_reason", C.reject_reason(F.col("src"), F.col("ref")))


def corpus_filter_reasons(spark, d):
    return reasoned(spark, d).groupBy("reject_reason").agg(F.count("*").alias("n"))


def corpus_filter_kept(spark, d):
    return reasoned(spark, d).filter("reject_reason IS NULL").select("id", "src", "ref")


def token_counts(spark, d):
    return table(spark, d, "documents").select("lang", F.explode(X.words(F.lower("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))


def lemma_groups(spark, d):
    t = V.german_tokens(spark, d).groupBy("token").agg(F.count("*").alias("n"))
    return t.groupBy(T.lemma(F.col("token")).alias("lemma")).agg(F.count("*").alias("forms"), F.sum("n").alias("n"))


def noun_bases(spark, d):
    return V.german_tokens(spark, d).distinct().select("token", T.noun_base(F.col("token")).alias("base"))


SUFFIXES = ("lich", "ung", "heit", "keit")


def technical_adjectives(spark, d):
    return T.suffix_terms(V.german_tokens(spark, d), SUFFIXES).withColumn("variants", F.array_join("variants", ","))


STEMS = [("ung", "bild"), ("bild", "bild"), ("lich", "gleich"), ("eit", "weit"), ("sch", "schau"), ("chau", "schau")]


def patent_verbs(spark, d):
    return T.stem_terms(V.german_tokens(spark, d), STEMS, ("die", "der")).withColumn("forms", F.array_join("forms", ","))


def compound_parts(spark, d):
    return V.german_tokens(spark, d).distinct().filter(F.length("token") >= 8).select("token", F.explode(T.compound_parts(F.col("token"))).alias("part"))


LINK_SQL = ", ".join(f"'{x}'" for x in T.LINKS)


def sentence_align(spark, d):
    s = table(spark, d, "documents").select("doc_id", "lang", X.sentences(F.col("text")).alias("s"))
    nxt = s.select((F.col("doc_id") - 1).alias("doc_id"), "lang", F.col("s").alias("t"))
    return C.align(s.join(nxt, ["doc_id", "lang"]), "s", "t", "doc_id")


def source_distribution(spark, d):
    c = table(spark, d, "documents").groupBy(F.substring("source", 1, 4).alias("class")).agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "class").limit(10)


def split_assignment(spark, d):
    return C.split_by_rank(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


def split_stats(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "text")
    return C.split_by_rank(docs, "doc_id", (0.9, 0.05), floor=60).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.avg("n_chars").alias("avg_chars"))


SPLIT = """r AS (SELECT *, row_number() OVER (ORDER BY (doc_id * 2654435761 + 42) % 4294967296, doc_id) AS k, count(*) OVER () AS n FROM documents)"""


def cooccurrence_terms(spark, d):
    return T.cooccurrence(V.pairs(spark, d), ("the", "of"), min_count=3, min_consistency=0.3)


def correction_patterns(spark, d):
    return T.corrections(V.translated(spark, d), min_total=3, min_together=2)


def bigram_corrections(spark, d):
    return T.corrections(V.translated(spark, d), grams=True, min_total=2, min_together=2, most=25)


def bigram_corrections_whole(spark, d):
    """As ``bigram_corrections``, of all pairs: also those that differ in more than 25 bigrams."""
    return T.whole_corrections(V.translated(spark, d), grams=True, min_total=2, min_together=2)


def corrections_sql(unit: str, total: int, together: int, most: int | None) -> str:
    """``most``: None for all pairs."""
    kept = f" WHERE len(gone) <= {most} AND len(new) <= {most}" if most is not None else ""
    return rf"""WITH {V.TRANSLATED}, s AS (SELECT id, {unit.format("mt")} AS m, {unit.format("ref")} AS r FROM translated),
d AS (SELECT id, list_filter(m, lambda x: NOT list_contains(r, x)) AS gone, list_filter(r, lambda x: NOT list_contains(m, x)) AS new FROM s),
k AS (SELECT * FROM d{kept}), one AS (SELECT id, unnest(gone) AS wrong, new FROM k),
t AS (SELECT wrong, count(*) AS total FROM one GROUP BY wrong HAVING count(*) >= {total}),
c AS (SELECT wrong, "right", count(*) AS together FROM (SELECT wrong, unnest(new) AS "right" FROM one) GROUP BY ALL),
b AS (SELECT wrong, total, "right", together, row_number() OVER (PARTITION BY wrong ORDER BY together DESC, "right" DESC) AS k FROM t JOIN c USING (wrong))
SELECT wrong, total, "right", together, together / total AS consistency FROM b WHERE k = 1 AND together >= {together} AND together / total >= 0.4"""


UNIT = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+'))"
GRAM = r"list_distinct(list_transform(range(1, len(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+'))), lambda i: regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+')[i] || ' ' || regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+')[i + 1]))"


def german_sentences(spark, d):
    return X.split_sentences(table(spark, d, "documents").filter("lang = 'de'"))


def glossary_match_topk(spark, d):
    return T.glossary_matches(german_sentences(spark, d), V.GLOSSARY)


def glossary_violations(spark, d):
    s = german_sentences(spark, d).select("doc_id", "idx", F.col("sentence").alias("src"), F.lower(F.regexp_replace("sentence", "ung", "ing")).alias("mt"))
    return T.glossary_violations(s, V.GLOSSARY).filter(F.size("violations") > 0).select("doc_id", "idx", F.array_join("violations", ";").alias("violations"))


def bench_terms(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.posexplode(X.words(F.lower("text"))).alias("pos", "de"))
    return b.select("de", F.substring("de", 1, 3).alias("en"), F.concat(F.lit("s"), F.col("item_id") % 2).alias("source"), (F.col("item_id") * 1000 + F.col("pos")).alias("line_no"))


BENCH = r"""terms AS (SELECT de, substr(de, 1, 3) AS en, 's' || (item_id % 2) AS source, item_id * 1000 + pos AS line_no FROM (SELECT item_id, unnest(range(len(w))) AS pos, unnest(w) AS de FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM benchmark)))"""


def insert_or_ignore_terms(spark, d):
    t = bench_terms(spark, d)
    return C.insert_or_ignore(t.filter("line_no < 10000"), t.filter("line_no >= 10000"), ["de", "en", "source"]).groupBy("source").agg(F.count("*").alias("inserted"))


def last_wins_glossary(spark, d):
    return T.last_wins(bench_terms(spark, d).withColumn("en", F.col("line_no").cast("string")), "de", "en", "line_no")


def duplicate_terms(spark, d):
    return bench_terms(spark, d).groupBy("de", "en").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources")).filter("n > 1")


def strongest_terms(spark, d):
    t = bench_terms(spark, d).groupBy("en", "de").agg(F.count("*").alias("freq"))
    return C.first_wins(t, ["en"], F.desc("freq"), "de")


def stem_filter(spark, d):
    """Documents with any of the stems, each once, and how many of the stems."""
    stems = ("ung", "tion", "ment", "ling")
    hits = sum(F.when(F.lower("text").contains(s), 1).otherwise(0) for s in stems)
    return table(spark, d, "documents").filter(F.lower("text").rlike("|".join(stems))).select("doc_id", hits.alias("stems"))


def language_check(spark, d):
    """Share of capitalised words in the first five sentences."""
    w = V.sentences(spark, d).filter("idx < 5").select("doc_id", F.explode(X.words(F.col("sentence"))).alias("w"))
    first = F.substring("w", 1, 1)
    r = w.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if((first == F.upper(first)) & (first != F.lower(first))).alias("capitals"))
    return r.select("doc_id", (F.col("capitals") / F.col("n")).alias("ratio"), (F.col("capitals") / F.col("n") < 0.15).alias("maybe_english"))


def length_histogram(spark, d):
    return V.sentences(spark, d).groupBy(F.floor(F.length("sentence") / 20).alias("bin")).agg(F.count("*").alias("n"))


def value_counts_top20(spark, d):
    t = table(spark, d, "documents").select(F.explode(X.words(F.lower("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "token").limit(20)


def char_budget(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", "text", (F.col("item_id") % 3).alias("priority"))
    return C.within_budget(rows, "text", "priority", "item_id", 3000).select("item_id", "chars_so_far")


def eval_sample_tertiles(spark, d):
    return C.tertile_sample(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", (60, 25, 15)).select("doc_id", "tier")


def adaptive_threshold(spark, d):
    n = V.sentences(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.select("doc_id", F.greatest(F.lit(2), F.least(F.lit(8), F.bround(F.col("n") / 20).cast("int"))).alias("threshold"))


def word_edit_distance(spark, d):
    return V.translated(spark, d).select("id", M.ter(F.col("mt"), F.col("ref")).alias("ter"))


def diff_ratio(spark, d):
    return V.translated(spark, d).select("id", M.matching_ratio("mt", "ref").alias("ratio"))


def bleu_chrf(spark, d):
    t = V.translated(spark, d).withColumn("domain", F.col("id") % 3)
    return M.corpus_scores(M.ngram_statistics(t, "mt", "ref", "domain"), "domain")


def variant_clusters(spark, d):
    t = table(spark, d, "documents").filter("lang = 'de'").select("doc_id", F.explode(X.words(F.col("text"))).alias("token")).filter("length(token) >= 4").groupBy("doc_id", "token").agg(F.count("*").alias("total"))
    return T.variant_clusters(t, "doc_id")


def three_stage_terms(spark, d):
    return T.three_stage_lookup(german_sentences(spark, d), V.GLOSSARY)


def bleu_chrf_sql() -> str:
    """Words and characters of both texts, grams by place, clipped counts a pair, sums a domain."""
    words = lambda c: rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> '')"
    grams = lambda side, kind, unit: f"SELECT id, '{side}' AS side, '{kind}' AS kind, n, array_to_string({unit}[i:i + n - 1], chr(30)) AS g FROM (SELECT id, n, {unit}, unnest(range(1, len({unit}) - n + 2)) AS i FROM t, (SELECT unnest(range(1, {5 if kind == 'w' else 7})) AS n))"
    return f"""WITH {V.TRANSLATED}, w AS (SELECT id, {words("mt")} AS hw, {words("ref")} AS rw FROM translated), t AS (SELECT *, list_filter(string_split(array_to_string(hw, ''), ''), lambda x: x <> '') AS hc, list_filter(string_split(array_to_string(rw, ''), ''), lambda x: x <> '') AS rc FROM w),
g AS ({" UNION ALL ".join(grams(s, k, s + k) for s in "hr" for k in "wc")}), c AS (SELECT id, side, kind, n, g, count(*) AS k FROM g GROUP BY ALL),
m AS (SELECT h.id, h.kind, h.n, sum(least(h.k, r.k)) AS m FROM c h JOIN c r ON h.side = 'h' AND r.side = 'r' AND h.id = r.id AND h.kind = r.kind AND h.n = r.n AND h.g = r.g GROUP BY ALL),
total AS (SELECT id % 3 AS domain, kind, n, count(*) FILTER (side = 'h') AS hyp, count(*) FILTER (side = 'r') AS ref FROM g GROUP BY ALL), match AS (SELECT id % 3 AS domain, kind, n, sum(m) AS m FROM m GROUP BY ALL),
s AS (SELECT domain, kind, n, hyp, ref, coalesce(m, 0) AS m FROM total LEFT JOIN match USING (domain, kind, n)), l AS (SELECT id % 3 AS domain, count(*) AS n_segments, sum(len(hw)) AS h, sum(len(rw)) AS r FROM t GROUP BY 1),
b AS (SELECT domain, CASE WHEN min(m) > 0 AND count(*) = 4 THEN exp(avg(ln(m / hyp))) ELSE 0 END AS p FROM s WHERE kind = 'w' GROUP BY 1), f AS (SELECT domain, sum(CASE WHEN m > 0 THEN 5 * (m / hyp) * (m / ref) / (4 * (m / hyp) + m / ref) ELSE 0 END) / 6 AS f FROM s WHERE kind = 'c' GROUP BY 1)
SELECT domain, n_segments, 100 * p * CASE WHEN h < r THEN exp(1 - r / h) ELSE 1 END AS bleu, 100 * f AS chrf FROM l JOIN b USING (domain) JOIN f USING (domain)"""


GER_SENT = SENTENCES_SQL.replace("FROM documents)", "FROM documents WHERE lang = 'de')")
QUERIES = {
    "corpus_filter_reasons": (corpus_filter_reasons, f"WITH {V.PAIRS} SELECT {REASON} AS reject_reason, count(*) AS n FROM pairs GROUP BY 1"),
    "corpus_filter_kept": (corpus_filter_kept, f"WITH {V.PAIRS} SELECT * FROM pairs WHERE {REASON} IS NULL"),
    "token_counts": (token_counts, f"SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({WORDS.format('text')}) AS token FROM documents) GROUP BY ALL"),
    "lemma_groups": (lemma_groups, f"WITH {V.GERMAN}, t AS (SELECT token, count(*) AS n FROM tokens GROUP BY token) SELECT {V.stripped_sql('token', T.LEMMA_ENDINGS, 3)} AS lemma, count(*) AS forms, sum(n)::BIGINT AS n FROM t GROUP BY 1"),
    "noun_bases": (noun_bases, f"WITH {V.GERMAN} SELECT DISTINCT token, CASE WHEN length(rtrim(rtrim(rtrim(token, 's'), 'n'), 'e')) >= 3 THEN rtrim(rtrim(rtrim(token, 's'), 'n'), 'e') ELSE token END AS base FROM tokens"),
    "technical_adjectives": (technical_adjectives, f"""WITH {V.GERMAN}, t AS (SELECT token, count(*) AS n, {V.stripped_sql('token', T.ADJECTIVE_ENDINGS, 4)} AS base FROM tokens WHERE length(token) >= 6 GROUP BY token HAVING count(*) >= 2)
SELECT base, sum(n)::BIGINT AS frequency, array_to_string(list_sort(list(DISTINCT token)), ',') AS variants FROM t WHERE regexp_matches(token, '(lich|ung|heit|keit)$') OR regexp_matches(base, '(lich|ung|heit|keit)$') GROUP BY base"""),
    "patent_verbs": (patent_verbs, f"""WITH {V.GERMAN}, stems(stem, base) AS (VALUES {V.sql_list(STEMS)}), t AS (SELECT token, count(*) AS n FROM tokens WHERE token NOT IN ('die', 'der') GROUP BY token),
s AS (SELECT stem, base, sum(n)::BIGINT AS frequency, list_sort(list(DISTINCT token))[1:5] AS forms FROM t JOIN stems ON contains(token, stem) GROUP BY stem, base),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY frequency DESC, stem) AS k FROM s) SELECT base, frequency, array_to_string(forms, ',') AS forms FROM r WHERE k = 1 AND frequency >= 3"""),
    "compound_parts": (compound_parts, f"""WITH {V.GERMAN}, w AS (SELECT DISTINCT token FROM tokens WHERE length(token) >= 8), c AS (SELECT token, unnest(range(4, length(token) - 3)) AS i FROM w),
p AS (SELECT token, substr(token, i + 1) AS part FROM c UNION SELECT token, substr(token, 1, i - length(x)) FROM c, (SELECT unnest([{LINK_SQL}]) AS x) WHERE suffix(substr(token, 1, i), x) AND i - length(x) >= 4) SELECT token, part FROM p"""),
    "sentence_align": (sentence_align, f"""WITH {SENTENCES_SQL}, j AS (SELECT a.doc_id, a.s AS s, b.s AS t FROM kept a JOIN kept b ON b.doc_id = a.doc_id + 1 AND a.lang = b.lang WHERE len(a.s) > 0 AND len(b.s) > 0 AND abs(len(a.s) - len(b.s)) <= 1)
SELECT doc_id, i::INT AS idx, s[i + 1] AS src, t[i + 1] AS ref FROM (SELECT *, unnest(range(least(len(s), len(t)))) AS i FROM j)"""),
    "source_distribution": (source_distribution, "SELECT substr(source, 1, 4) AS class, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, class LIMIT 10"),
    "split_assignment": (split_assignment, f"WITH {SPLIT} SELECT doc_id, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r"),
    "split_stats": (split_stats, f"""WITH {SPLIT}, s AS (SELECT *, greatest(60, floor(n * 0.05)) AS v FROM r), a AS (SELECT *, CASE WHEN k <= greatest(0, n - 2 * v) THEN 'train' WHEN k <= greatest(0, n - 2 * v) + v THEN 'val' ELSE 'test' END AS split FROM s)
SELECT split, count(*) AS n, sum(length(text))::BIGINT AS chars, avg(n_chars) AS avg_chars FROM a GROUP BY split"""),
    "cooccurrence_terms": (cooccurrence_terms, rf"""WITH {V.PAIRS}, s AS (SELECT id, list_filter({UNIT.format("src")}, lambda x: length(x) >= 3 AND x NOT IN ('the', 'of')) AS s, list_filter({UNIT.format("ref")}, lambda x: length(x) >= 3 AND x NOT IN ('the', 'of')) AS t FROM pairs),
one AS (SELECT unnest(s) AS term, t FROM s), f AS (SELECT term, count(*) AS frequency FROM one GROUP BY term HAVING count(*) >= 3), c AS (SELECT term, partner, count(*) AS together FROM (SELECT term, unnest(t) AS partner FROM one) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY together DESC, partner DESC) AS k FROM f JOIN c USING (term)) SELECT term, partner, frequency, together, together / frequency AS consistency FROM b WHERE k = 1 AND together / frequency >= 0.3"""),
    "correction_patterns": (correction_patterns, corrections_sql(UNIT, 3, 2, 15)),
    "bigram_corrections": (bigram_corrections, corrections_sql(GRAM, 2, 2, 25)),
    "bigram_corrections_whole": (bigram_corrections_whole, corrections_sql(GRAM, 2, 2, None)),
    "glossary_match_topk": (glossary_match_topk, f"""WITH {GER_SENT}, g(de, en) AS (VALUES {V.sql_list(V.GLOSSARY)}), r AS (SELECT doc_id, idx, de, en, row_number() OVER (PARTITION BY doc_id, idx ORDER BY length(de) DESC, de, en) AS rank FROM sentences JOIN g ON contains(lower(sentence), de))
SELECT doc_id, idx, de, en, rank::INT AS rank FROM r WHERE rank <= 5"""),
    "glossary_violations": (glossary_violations, f"""WITH {GER_SENT}, g(k, de, en) AS (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(V.GLOSSARY))}), p AS (SELECT doc_id, idx, lower(sentence) AS s, lower(replace(sentence, 'ung', 'ing')) AS mt FROM sentences)
SELECT doc_id, idx, string_agg(de || '=' || en, ';' ORDER BY k) AS violations FROM p JOIN g ON contains(s, de) AND NOT contains(mt, en) GROUP BY doc_id, idx"""),
    "insert_or_ignore_terms": (insert_or_ignore_terms, f"WITH {V.GERMAN.split(' AS ')[0]} AS (SELECT 1), {BENCH} SELECT source, count(*) AS inserted FROM (SELECT DISTINCT de, en, source FROM terms n WHERE line_no >= 10000 AND NOT EXISTS (SELECT 1 FROM terms e WHERE e.line_no < 10000 AND e.de = n.de AND e.en = n.en AND e.source = n.source)) GROUP BY source"),
    "last_wins_glossary": (last_wins_glossary, f"WITH {BENCH} SELECT de, max(line_no)::VARCHAR AS en FROM terms GROUP BY de"),
    "duplicate_terms": (duplicate_terms, f"WITH {BENCH} SELECT de, en, count(*) AS n, count(DISTINCT source) AS sources FROM terms GROUP BY de, en HAVING count(*) > 1"),
    "strongest_terms": (strongest_terms, f"WITH {BENCH}, f AS (SELECT en, de, count(*) AS freq FROM terms GROUP BY en, de) SELECT en, de, freq FROM (SELECT *, row_number() OVER (PARTITION BY en ORDER BY freq DESC, de) AS k FROM f) WHERE k = 1"),
    "stem_filter": (stem_filter, "SELECT * FROM (SELECT doc_id, contains(lower(text), 'ung')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'ment')::INT + contains(lower(text), 'ling')::INT AS stems FROM documents) WHERE stems > 0"),
    "language_check": (language_check, rf"""WITH {SENTENCES_SQL}, w AS (SELECT doc_id, unnest(regexp_extract_all(sentence, '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS w FROM sentences WHERE idx < 5), r AS (SELECT doc_id, count(*) FILTER (w[1] = upper(w[1]) AND w[1] <> lower(w[1])) / count(*) AS ratio FROM w GROUP BY doc_id)
SELECT doc_id, ratio, ratio < 0.15 AS maybe_english FROM r"""),
    "length_histogram": (length_histogram, f"WITH {SENTENCES_SQL} SELECT floor(length(sentence) / 20)::BIGINT AS bin, count(*) AS n FROM sentences GROUP BY 1"),
    "value_counts_top20": (value_counts_top20, f"SELECT token, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 20"),
    "char_budget": (char_budget, "SELECT * FROM (SELECT item_id, (sum(length(text)) OVER (ORDER BY item_id % 3, item_id))::BIGINT AS chars_so_far FROM benchmark) WHERE chars_so_far <= 3000"),
    "eval_sample_tertiles": (eval_sample_tertiles, """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS k, count(*) OVER () // 3 AS third FROM documents), t AS (SELECT doc_id, CASE WHEN k <= third THEN 0 WHEN k <= 2 * third THEN 1 ELSE 2 END AS tier FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY (doc_id * 2654435761 + 42) % 4294967296, doc_id) AS k FROM t) SELECT doc_id, tier::INT AS tier FROM p WHERE k <= [60, 25, 15][tier + 1]"""),
    "adaptive_threshold": (adaptive_threshold, f"WITH {SENTENCES_SQL} SELECT doc_id, greatest(2, least(8, round_even(count(*) / 20, 0)))::INT AS threshold FROM sentences GROUP BY doc_id"),
    "word_edit_distance": (word_edit_distance, None),
    "diff_ratio": (diff_ratio, None),
    "bleu_chrf": (bleu_chrf, bleu_chrf_sql()),
    "variant_clusters": (variant_clusters, None),
    "three_stage_terms": (three_stage_terms, None),
}
QUERIES["insert_or_ignore_terms"] = (insert_or_ignore_terms, QUERIES["insert_or_ignore_terms"][1].replace(f"WITH {V.GERMAN.split(' AS ')[0]} AS (SELECT 1), ", "WITH "))
