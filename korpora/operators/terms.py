"""Terminology: bases, compounds, co-occurrence, corrections, glossary matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpora.functions import lexicons as W
from korpora.functions.text import once, strip_suffix, words
from korpora.session import written

#: Endings tried in this order.
LEMMA_ENDINGS = ("en", "er", "es", "e", "n", "s")
ADJECTIVE_ENDINGS = ("en", "em", "er", "es", "e")
#: Letters between the parts of a compound.
LINKS = ("", "s", "n", "en", "er", "es")


def lemma(word: Column) -> Column:
    return strip_suffix(F.lower(word), LEMMA_ENDINGS, 3)


def adjective_base(word: Column) -> Column:
    return strip_suffix(word, ADJECTIVE_ENDINGS, 4)


def noun_base(word: Column) -> Column:
    """Without runs of s, then n, then e at the end; the word itself if fewer than three letters stay."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "s+$", ""), "n+$", ""), "e+$", "")
    return F.when(F.length(base) >= 3, base).otherwise(word)


def compound_parts(word: Column, shortest: int = 4, least: int = 8) -> Column:
    """All parts of all two-part splits, linking letters dropped from the first part."""
    w = F.lower(word)
    cuts = F.transform(
        F.sequence(F.lit(shortest), F.length(w) - shortest),
        lambda i: F.concat(F.filter(F.transform(F.array(*map(F.lit, LINKS)), lambda x: F.when(F.substring(w, 1, i).endswith(x), F.substring(w, F.lit(1), i - F.length(x)))), lambda p: F.length(p) >= shortest), F.array(F.substring(w, i + 1, F.length(w)))),
    )
    return F.when(F.length(w) >= least, F.array_sort(F.array_distinct(F.flatten(cuts)))).otherwise(F.array())


def content_words(text: Column, stop: tuple[str, ...], shortest: int = 3) -> Column:
    kept = F.filter(F.array_distinct(words(F.lower(text))), lambda w: F.length(w) >= shortest)
    return F.array_except(kept, F.array(*map(F.lit, stop))) if stop else kept


def cooccurrence(pairs: DataFrame, stop: tuple[str, ...] = (), min_count: int = 10, min_consistency: float = 0.6, longest: int | None = None) -> DataFrame:
    """For each source word the target word it occurs with most, kept if often and consistently enough.

    Source words rarer than the threshold go before the words of a pair are multiplied out.
    """
    sets = pairs.select(content_words(F.col("src"), stop).alias("s"), content_words(F.col("ref"), stop).alias("t"))
    if longest:
        sets = sets.filter((F.size("s") <= longest) & (F.size("t") <= longest))
    single = sets.select(F.explode("s").alias("term"), "t")
    frequency = single.groupBy("term").agg(F.count("*").alias("frequency")).filter(F.col("frequency") >= min_count)
    counts = single.join(frequency, "term").select("term", "frequency", F.explode("t").alias("partner")).groupBy("term", "frequency", "partner").agg(F.count("*").alias("together"))
    best = counts.groupBy("term", "frequency").agg(F.max(F.struct("together", "partner")).alias("b"))
    return best.select("term", F.col("b.partner").alias("partner"), "frequency", F.col("b.together").alias("together"), (F.col("b.together") / F.col("frequency")).alias("consistency")).filter(F.col("consistency") >= min_consistency)


def by_strength(terms: DataFrame) -> DataFrame:
    """Mined terms, frequent and consistent ones first; ties by term and partner."""
    rows = terms.withColumn("strength", F.col("frequency") * F.col("consistency"))
    return rows.orderBy(F.desc("strength"), "term", "partner")


def bigrams(w: Column) -> Column:
    return F.when(F.size(w) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))))).otherwise(F.array())


def differing(pairs: DataFrame, grams: bool) -> DataFrame:
    """``gone`` and ``new``: words (or bigrams) of ``mt`` that ``ref`` lacks, and the reverse."""
    unit = (lambda c: once(words(F.lower(c)), bigrams)) if grams else (lambda c: F.array_distinct(words(F.lower(c))))
    both = F.struct(unit(F.col("mt")).alias("m"), unit(F.col("ref")).alias("r"))
    return pairs.select(once(both, lambda x: F.struct(F.array_except(x["m"], x["r"]).alias("gone"), F.array_except(x["r"], x["m"]).alias("new"))).alias("d")).select("d.*")


def corrections(pairs: DataFrame, grams: bool = False, min_total: int = 5, min_together: int = 3, min_consistency: float = 0.4, most: int = 15) -> DataFrame:
    """Words (or bigrams) of the machine text that the reference lacks, with the reference word they give way to most. Pairs that differ in more than ``most`` don't count; ``whole_corrections`` takes all."""
    diff = differing(pairs, grams).filter((F.size("gone") <= most) & (F.size("new") <= most))
    single = diff.select(F.explode("gone").alias("wrong"), "new")
    total = single.groupBy("wrong").agg(F.count("*").alias("total")).filter(F.col("total") >= min_total)
    counts = single.join(total, "wrong").select("wrong", "total", F.explode("new").alias("right")).groupBy("wrong", "total", "right").agg(F.count("*").alias("together"))
    best = counts.groupBy("wrong", "total").agg(F.max(F.struct("together", "right")).alias("b")).select("wrong", "total", "b.right", "b.together")
    return best.withColumn("consistency", F.col("together") / F.col("total")).filter((F.col("together") >= min_together) & (F.col("consistency") >= min_consistency))


def whole_corrections(pairs: DataFrame, grams: bool = False, min_total: int = 5, min_together: int = 3, min_consistency: float = 0.4) -> DataFrame:
    """``corrections`` of all pairs, however much they differ.

    What is met in the same pairs (told by 128 bits) has the same counts, so one word stands for its class before words of a pair are multiplied out: words that only one pair has are one class, not thousands.
    Words met too seldom go first, and of the products those whose second word is too rare to be consistent with the first.
    """
    rows = written(differing(pairs, grams).filter(F.size("gone") > 0).select(F.monotonically_increasing_id().alias("_key"), "gone", "new"), "correction-sets")

    def classes(side: str, least: int) -> DataFrame:
        mark = lambda n: F.bit_xor(F.xxhash64(F.lit(n), "_key")).alias(f"h{n}")
        met = rows.select("_key", F.explode(side).alias("word")).groupBy("word").agg(F.count("*").alias("n"), mark(0), mark(1)).filter(F.col("n") >= least)
        return met.groupBy("n", "h0", "h1").agg(F.max("word").alias("first"), F.collect_list("word").alias("words")).drop("h0", "h1")

    def standing(side: str, found: DataFrame) -> DataFrame:
        return rows.select("_key", F.explode(side).alias("first")).join(found.select("first", "n"), "first").groupBy("_key").agg(F.collect_list(F.struct("first", "n")).alias(side))

    gone = written(classes("gone", max(min_total, min_together)), "correction-classes")
    both = standing("gone", gone).join(standing("new", classes("new", min_together)), "_key").select(F.explode("gone").alias("g"), "new").select("g", F.explode("new").alias("w"))
    enough = lambda n: (F.col(n) >= min_together) & (F.col(n) / F.col("total") >= min_consistency)
    likely = both.select(F.col("g.first").alias("first"), F.col("g.n").alias("total"), F.col("w.first").alias("right"), F.col("w.n").alias("most")).filter(enough("most"))
    counts = likely.groupBy("first", "total", "right").agg(F.count("*").alias("together")).filter(enough("together"))
    best = counts.groupBy("first", "total").agg(F.max(F.struct("together", "right")).alias("b"))
    return best.join(gone.select("first", "words"), "first").select(F.explode("words").alias("wrong"), "total", "b.right", "b.together", (F.col("b.together") / F.col("total")).alias("consistency"))


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def glossary_matches(sentences: DataFrame, glossary: list[tuple[str, str]], most: int = 5, whole_words: bool = False) -> DataFrame:
    """(doc_id, idx, de, en, rank): the longest entries found in a sentence, up to ``most``.

    The glossary is a parameter; a regular expression finds the sentences with any entry before they are multiplied by entries.
    """
    import re

    entries = F.array(*[F.struct(F.lit(d).alias("de"), F.lit(e).alias("en")) for d, e in glossary])
    low = F.lower("sentence")
    any_of = "|".join(re.escape(d.lower()) for d, _ in glossary)
    fits = (lambda g: F.regexp_like(low, F.concat(F.lit(r"(?U)\b\Q"), F.lower(g["de"]), F.lit(r"\E\b")))) if whole_words else (lambda g: low.contains(F.lower(g["de"])))
    hits = F.filter(entries, fits)
    ordered = F.slice(F.transform(F.array_sort(F.transform(hits, lambda g: F.struct((-F.length(g["de"])).alias("n"), g["de"].alias("de"), g["en"].alias("en")))), lambda g: F.struct(g["de"].alias("de"), g["en"].alias("en"))), 1, most)
    return sentences.filter(low.rlike(any_of)).select("doc_id", "idx", F.posexplode(ordered).alias("rank", "g")).select("doc_id", "idx", "g.de", "g.en", (F.col("rank") + 1).alias("rank"))


def glossary_violations(pairs: DataFrame, glossary: list[tuple[str, str]]) -> DataFrame:
    """Adds ``violations``: entries whose source term is there and whose target term isn't."""
    entries = F.array(*[F.struct(F.lit(d).alias("de"), F.lit(e).alias("en")) for d, e in glossary])
    bad = F.filter(entries, lambda g: F.lower("src").contains(F.lower(g["de"])) & ~F.lower("mt").contains(F.lower(g["en"])))
    return pairs.withColumn("violations", F.transform(bad, lambda g: F.concat(g["de"], F.lit("="), g["en"])))


def three_stage_lookup(sentences: DataFrame, terms: list[tuple[str, str]], most: int = 5) -> DataFrame:
    """Terms of a sentence in three stages: the phrase itself (longest first), lemmas of words, lemmas of compound parts; target terms once each.

    The choice in a stage depends on what was used before, so a sentence is worked through in Python, in Arrow batches; the term table travels with the task.
    """
    by_length = sorted({(d.lower(), e) for d, e in terms}, key=lambda t: (-len(t[0]), t))

    def simple(w: str) -> str:
        return next((w[: -len(s)] for s in LEMMA_ENDINGS if w.endswith(s) and len(w) > len(s) + 3), w)

    by_lemma: dict[str, list[str]] = {}
    for d, e in by_length:
        if " " not in d:
            by_lemma.setdefault(simple(d), []).append(e)

    def parts(w: str) -> list[str]:
        out = []
        for i in range(4, len(w) - 3):
            out += [w[: i - len(x)] for x in LINKS if w[:i].endswith(x) and i - len(x) >= 4] + [w[i:]]
        return list(dict.fromkeys(out)) if len(w) >= 8 else []

    @F.pandas_udf("array<struct<stage: int, found: string, en: string>>")
    def look(texts: pd.Series) -> pd.Series:
        import re

        rows = []
        for t in texts:
            low, out, used = (t or "").lower(), [], set()

            def take(stage, found, options, out=out, used=used):
                for e in options:
                    if len(out) < most and e.lower() not in used:
                        used.add(e.lower())
                        out.append((stage, found, e))
                        return

            for d, e in by_length:
                if d in low:
                    take(1, d, [e])
            ws = re.findall(r"\w+", low)
            for w in ws:
                take(2, w, by_lemma.get(simple(w), ()))
            for w in ws:
                for p in parts(w):
                    take(3, p, by_lemma.get(simple(p), ()))
            rows.append([{"stage": s, "found": f, "en": e} for s, f, e in out])
        return pd.Series(rows)

    return sentences.select("doc_id", "idx", F.explode(look("sentence")).alias("m")).select("doc_id", "idx", "m.stage", "m.found", "m.en")


def variant_clusters(nouns: DataFrame, group: str, extra: int = 3) -> DataFrame:
    """Nouns of a group by their variants: short words first, each takes unused ones with its base or up to ``extra`` more letters. Columns group, token, total.

    Greedy and ordered, so a group is clustered in Python; a group is one document's vocabulary. Candidates come from an index by base and by prefix, not from all pairs.
    """

    def base(w: str) -> str:
        b = w.rstrip("s").rstrip("n").rstrip("e")
        return b if len(b) >= 3 else w

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(rows.token, rows.total, strict=True))
        order = sorted(counts, key=lambda w: (len(w), w))
        by_base: dict[str, list[str]] = {}
        by_prefix: dict[str, list[str]] = {}
        for w in order:
            by_base.setdefault(base(w), []).append(w)
            for k in range(1, extra + 1):
                by_prefix.setdefault(w[:-k], []).append(w)
        used, out = set(), []
        for w in order:
            if w not in used:
                own = [x for x in dict.fromkeys([w, *by_base[base(w)], *by_prefix.get(w, [])]) if x not in used]
                used.update(own)
                out.append((rows[group].iloc[0], w, int(sum(counts[x] for x in own)), sorted(own[1:])))
        return pd.DataFrame(out, columns=[group, "term", "frequency", "variants"])

    kind = dict(nouns.dtypes)[group]
    return nouns.groupBy(group).applyInPandas(work, f"{group} {kind}, term string, frequency long, variants array<string>")


def counted(condition: Column) -> Column:
    """A condition on words that is asked once a word: as it names the count, it can't be moved before the counting, where it would be asked once an occurrence."""
    return F.when(F.col("n") > 0, condition).otherwise(False)


def suffix_terms(tokens: DataFrame, suffixes: tuple[str, ...], shortest: int = 6, least: int = 2) -> DataFrame:
    """Lower-case words with a technical suffix, inflected or not, by base: summed frequency and variants. Column token."""
    ends = "|".join(suffixes)
    counts = tokens.filter(F.length("token") >= shortest).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    fits = counts.filter(counted(F.col("token").rlike(f"({ends})$") | adjective_base(F.col("token")).rlike(f"({ends})$")))
    return fits.groupBy(adjective_base(F.col("token")).alias("base")).agg(F.sum("n").alias("frequency"), F.array_sort(F.collect_set("token")).alias("variants"))


def technical_adjectives(tokens: DataFrame, suffixes: tuple[str, ...] = W.TECHNICAL_SUFFIXES, skip: tuple[str, ...] = W.COMMON_VERBS + W.ADVERBS, shortest: int = 6, least: int = 2) -> DataFrame:
    """(base, frequency, variants): words with a technical suffix and more than two letters before it, as they are or without their ending, by base. Words of ``skip`` and rare ones don't count. ``variants`` are the inflected forms. Column token."""
    fits = lambda w: F.exists(F.array(*[F.lit(s) for s in suffixes]), lambda s: w.endswith(s) & (F.length(w) > F.length(s) + 2))
    counts = tokens.filter((F.length("token") >= shortest) & ~F.col("token").isin(*skip)).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    base = adjective_base(F.col("token"))
    inflected = F.array_compact(F.collect_set(F.when(F.col("token") != F.col("base"), F.col("token"))))
    return counts.filter(counted(fits(F.col("token")) | fits(base))).withColumn("base", base).groupBy("base").agg(F.sum("n").alias("frequency"), F.array_sort(inflected).alias("variants"))


def stem_terms(tokens: DataFrame, stems: list[tuple[str, str]], common: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """(base, frequency, forms): per stem the words that contain it, per base the best stem (not the sum)."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    if common:
        counts = counts.filter(~F.col("token").isin(*common))
    pairs = F.array(*[F.struct(F.lit(s).alias("stem"), F.lit(b).alias("base")) for s, b in stems])
    hits = counts.filter(F.col("token").rlike("|".join(s for s, _ in stems))).select("token", "n", F.explode(F.filter(pairs, lambda p: F.col("token").contains(p["stem"]))).alias("p"))
    by_stem = hits.groupBy("p.stem", "p.base").agg(F.sum("n").alias("frequency"), F.slice(F.array_sort(F.collect_set("token")), 1, 5).alias("forms"))
    ranked = by_stem.withColumn("_k", F.row_number().over(Window.partitionBy("base").orderBy(F.desc("frequency"), "stem")))
    return ranked.filter((F.col("_k") == 1) & (F.col("frequency") >= least)).select("base", "frequency", "forms")
