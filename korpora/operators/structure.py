"""Structural difficulty of sentences from a table of parsed tokens.

Tokens: doc_id, idx, i, text, lemma, pos, tag, dep, head_i. A parser is a provider; the operators only need its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["doc_id", "idx"]
CLAUSE_DEPS = ("rc", "cp", "oc", "re", "cj")
RELATIVE = ("der", "die", "das", "dem", "den", "deren", "dessen", "denen")


def clause_depth(tokens: DataFrame, most: int = 64) -> DataFrame:
    """Per sentence the greatest number of clause-opening ancestors of a token: head pointers are followed a level a step, all tokens at once, inside an array of the sentence."""
    opens = F.col("dep").isin(*CLAUSE_DEPS) | (F.col("pos") == "SCONJ")
    sent = tokens.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("i", "head_i", F.when(opens, 1).otherwise(0).alias("c")))).alias("t"))
    at = lambda t, i: F.get(t, i)

    def depth(t: Column) -> Column:
        walk = lambda tok: F.aggregate(
            F.sequence(F.lit(1), F.least(F.size(t), F.lit(most))),
            F.struct(tok["i"].alias("at"), F.lit(0).alias("n"), F.lit(False).alias("end")),
            lambda s, _: F.struct(
                F.coalesce(at(t, s["at"])["head_i"], s["at"]).alias("at"),
                (s["n"] + F.when(s["end"] | (at(t, s["at"])["head_i"] == s["at"]), 0).otherwise(F.coalesce(at(t, at(t, s["at"])["head_i"])["c"], F.lit(0)))).alias("n"),
                (s["end"] | (at(t, s["at"])["head_i"] == s["at"])).alias("end"),
            ),
        )["n"]
        return F.array_max(F.transform(t, walk))

    return sent.select(*KEYS, depth(F.col("t")).alias("clause_depth"))


def verb_final_spans(tokens: DataFrame) -> DataFrame:
    """Per sentence: the longest span from a clause opener to the last verb before the clause ends (. ; or a comma after three tokens), and how many span more than two."""
    t = tokens.select(*KEYS, "i", "text", "pos", "dep")
    openers = t.filter((F.col("pos") == "SCONJ") | ((F.col("dep") == "rc") & F.col("pos").isin("PRON", "DET"))).select(*KEYS, F.col("i").alias("open"))
    after = openers.join(t, KEYS).filter("i > open")
    stop = F.min(F.when(F.col("text").isin(".", ";") | ((F.col("text") == ",") & (F.col("i") > F.col("open") + 3)), F.col("i")))
    ends = after.groupBy(*KEYS, "open").agg(stop.alias("stop"))
    last = after.join(ends, [*KEYS, "open"]).filter("i < coalesce(stop, 1000000) AND pos IN ('VERB', 'AUX')").groupBy(*KEYS, "open").agg((F.max("i") - F.col("open")).alias("span")).filter("span > 2")
    return last.groupBy(*KEYS).agg(F.max("span").alias("max_verb_final_span"), F.count("*").alias("n_verb_final_clauses"))


def features(tokens: DataFrame) -> DataFrame:
    """One row a sentence with the features that the score needs."""
    w = Window.partitionBy(*KEYS).orderBy("i")
    pattern = (F.lag("text").over(w) == ",") & F.lower("text").isin(*RELATIVE)
    rel = (F.col("dep") == "rc") | (F.lower("text").startswith("welch") & F.col("dep").isin("rc", "sb", "oa"))
    base = tokens.withColumn("_p", F.coalesce(pattern, F.lit(False))).groupBy(*KEYS).agg(
        F.count("*").alias("n_tokens"),
        F.greatest(F.count_if(rel), F.when(F.count_if("_p") > 0, 1).otherwise(0)).alias("n_relative_clauses"),
        F.coalesce(F.min(F.when((F.col("dep") == "ROOT") & F.col("pos").isin("VERB", "AUX"), F.col("i"))), F.lit(0)).alias("vorfeld_length"),
    )
    heads = tokens.select(*KEYS, F.col("i").alias("head_i"), F.col("pos").alias("head_pos"))
    dets = tokens.filter("pos = 'DET'").select(*KEYS, F.col("head_i"), F.col("i").alias("det_i")).groupBy(*KEYS, "head_i").agg(F.min("det_i").alias("det_i"))
    both = F.when(F.col("tag").contains("Part"), 1).otherwise(0) + F.when(F.lower("text").rlike("end(e|er|es|en|em)?$"), 1).otherwise(0)
    part = tokens.filter("pos = 'ADJ'").withColumn("_n", both).filter("_n > 0").join(heads, [*KEYS, "head_i"]).filter("head_pos IN ('NOUN', 'PROPN')").join(dets, [*KEYS, "head_i"]).withColumn("span", F.col("head_i") - F.col("det_i")).filter("span > 2")
    part = part.groupBy(*KEYS).agg(F.sum("_n").alias("n_participial_constructions"), F.max("span").alias("max_participial_span"))
    out = base.join(clause_depth(tokens), KEYS, "left").join(verb_final_spans(tokens), KEYS, "left").join(part, KEYS, "left")
    return out.na.fill(0)


NAMES = ("clause_depth", "max_verb_final_span", "n_verb_final_clauses", "n_relative_clauses", "n_participial_constructions", "max_participial_span", "vorfeld_length")


def scored(rows: DataFrame) -> DataFrame:
    """Adds risk_score, risk_level, risk_factors, translation_hint. Sentences of fewer than four tokens have no risk."""
    c, f = F.col, lambda x: F.lit(float(x))
    part = F.least(F.least(c("n_participial_constructions") / 2, f(1)) * 0.1 + F.when(c("max_participial_span") > 4, 0.05).otherwise(0.0), f(0.1))
    score = (
        F.least(F.greatest(c("n_tokens") - 10, F.lit(0)) / 160, f(0.25)) + F.least(c("clause_depth") / 3, f(1)) * 0.25 + F.least(c("max_verb_final_span") / 10, f(1)) * 0.2
        + F.least(c("n_relative_clauses") / 2, f(1)) * 0.1 + part + F.least(F.greatest(c("vorfeld_length") - 3, F.lit(0)) / 7, f(1)) * 0.1
    )
    tiny = c("n_tokens") < 4
    out = rows.select(*[x for x in rows.columns if x not in NAMES], *[F.when(tiny, 0).otherwise(c(x)).alias(x) for x in NAMES])
    factors = [(c("n_tokens") > 35, "long sentence"), (c("clause_depth") >= 2, "nested clauses"), (c("max_verb_final_span") > 5, "late verb"), (c("n_relative_clauses") >= 2, "relative clauses"), (c("n_participial_constructions") > 0, "extended attribute"), (c("vorfeld_length") > 5, "long first field")]
    hints = [(c("clause_depth") >= 2, "Split nested clauses."), (c("max_verb_final_span") > 5, "Move the final verb forward."), (c("n_participial_constructions") > 0, "Turn the attribute into a relative clause."), (c("vorfeld_length") > 5, "Put the subject first.")]
    out = out.withColumn("risk_score", F.when(tiny, 0.0).otherwise(F.round(score, 3)))
    out = out.withColumn("risk_level", F.when(c("risk_score") >= 0.5, "high").when(c("risk_score") >= 0.25, "medium").otherwise("low"))
    out = out.withColumn("risk_factors", F.when(tiny, F.array().cast("array<string>")).otherwise(F.filter(F.array(*[F.when(x, y) for x, y in factors]), lambda x: x.isNotNull())))
    return out.withColumn("translation_hint", F.when(c("risk_level") != "low", F.nullif(F.concat_ws(" ", *[F.when(x, y) for x, y in hints]), F.lit(""))))


def summary(rows: DataFrame) -> DataFrame:
    high = F.count_if(F.col("risk_level") == "high")
    return rows.agg(F.count("*").alias("sentences"), F.round(F.avg("risk_score"), 3).alias("avg_score"), high.alias("high"), F.count_if(F.col("risk_level") == "medium").alias("medium"), F.count_if(F.col("risk_level") == "low").alias("low"), F.avg("n_tokens").alias("avg_tokens"), F.max("clause_depth").alias("max_depth"))
