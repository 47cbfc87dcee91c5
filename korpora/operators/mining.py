"""Mining of terms and corrections from parallel text: consistent partners, corrections with the source word that calls for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpora.functions import lexicons as W
from korpora.functions.text import once, words
from korpora.operators.terms import bigrams
from korpora.session import BROADCAST_BYTES, octets, written

#: Rows of one source word that are counted together, and products of words for one task.
SHARE, PRODUCTS = 1 << 10, 1 << 20


def numeric(word: Column) -> Column:
    return word.rlike(r"^\p{Nd}+$")


def without(found: Column, stop: tuple[str, ...]) -> Column:
    return F.array_except(found, F.array(*[F.lit(w) for w in stop])) if stop else F.array_distinct(found)


def lower_words(text: str) -> Column:
    """Distinct words in lower case; none for null."""
    return F.array_distinct(words(F.lower(F.coalesce(F.col(text), F.lit("")))))


def sent(table: DataFrame, *texts: str) -> DataFrame:
    """A written table, marked to be sent to all executors if its bytes, counted, are few."""
    return F.broadcast(table) if octets(table, *texts) <= BROADCAST_BYTES else table


def term_pairs(
    pairs: DataFrame, source_stop: tuple[str, ...] = W.GERMAN_TERM_STOPWORDS, target_stop: tuple[str, ...] = W.ENGLISH_TERM_STOPWORDS, min_frequency: int = 10, min_consistency: float = 0.6,
    sizes: tuple[int, int] = (3, 40), shortest: tuple[int, int] = (4, 3), key: str = "id", share: int = SHARE, products: int = PRODUCTS,
) -> DataFrame:
    """(de_term, en_term, frequency, consistency): for each source word the target word found beside it most.

    Pairs whose sets of words (without stop words) are smaller or larger than ``sizes`` are noise and don't count. A source word's one best partner (ties by alphabet) decides: if it is the word itself or a number, or not consistent,
    the word has no term. Rare source words go before the words of a pair are multiplied out, and ``sizes`` bounds the products.

    Rows of a source word are dealt by ``key``, which names a row of ``pairs``, into shares of some ``share`` rows, and shares to tasks of some ``products`` products, so the memory of a task doesn't grow with the table. A consistent partner
    is met often enough in one of the word's shares at least; where there are several, such partners are counted once more, over all of them.
    """
    found = pairs.select(F.col(key).alias("_key"), without(lower_words("src"), source_stop).alias("s"), without(lower_words("ref"), target_stop).alias("t"))
    found = found.filter(F.size("s").between(*sizes) & F.size("t").between(*sizes))
    long = lambda c, n: F.filter(c, lambda w: F.length(w) >= n)
    sets = written(found.select("_key", long("s", shortest[0]).alias("s"), long("t", shortest[1]).alias("t")), "term-sets")
    tasks = -(-(sets.agg(F.sum(F.size("s").cast("long") * F.size("t"))).head()[0] or 1) // products)
    often = sets.select(F.explode("s").alias("de_term")).groupBy("de_term").agg(F.count("*").alias("frequency")).filter(F.col("frequency") >= min_frequency)
    often = written(often.withColumn("shares", F.ceil(F.col("frequency") / share)), "term-frequencies")
    one = sets.select("_key", F.explode("s").alias("de_term"), "t").join(sent(often, "de_term"), "de_term")
    dealt = one.select("de_term", "frequency", "shares", F.pmod(F.xxhash64("_key"), "shares").alias("share"), "t").repartition(int(tasks), "de_term", "share")
    counts = dealt.withColumn("en_term", F.explode("t")).groupBy("de_term", "share", "en_term", "frequency", "shares").agg(F.count("*").alias("together"))
    near = written(counts.filter(F.col("together") * F.col("shares") / F.col("frequency") >= min_consistency * (1 - 1e-9)), "term-partners")
    again = written(near.filter("shares > 1").groupBy("de_term").agg(F.collect_set("en_term").alias("near")), "term-partners-again")
    over = one.filter("shares > 1").join(sent(again.withColumn("_near", F.array_join("near", "")), "de_term", "_near").drop("_near"), "de_term").select("de_term", "frequency", F.explode(F.array_intersect("t", "near")).alias("en_term"))
    counts = near.filter("shares = 1").select("de_term", "frequency", "en_term", "together").unionByName(over.groupBy("de_term", "frequency", "en_term").agg(F.count("*").alias("together")))
    best = counts.groupBy("de_term", "frequency").agg(F.min(F.struct((-F.col("together")).alias("n"), F.col("en_term"))).alias("b"))
    found = best.select("de_term", "b.en_term", "frequency", (-F.col("b.n") / F.col("frequency")).alias("consistency"))
    return found.filter((F.col("consistency") >= min_consistency) & (F.col("de_term") != F.col("en_term")) & ~numeric(F.col("de_term")) & ~numeric(F.col("en_term")))


def differences(pairs: DataFrame, most: int = 15, stop: tuple[str, ...] = W.ENGLISH_STOPWORDS, shortest: int = 3) -> DataFrame:
    """The columns of ``pairs`` with ``gone`` and ``new``: words of ``mt`` that ``ref`` lacks, and the reverse; pairs that differ in more than ``most`` words are left out."""
    own = lambda a, b: F.filter(without(F.array_except(a, b), stop), lambda w: (F.length(w) >= shortest) & ~numeric(w))
    both = F.struct(lower_words("mt").alias("m"), lower_words("ref").alias("r"))
    found = once(both, lambda x: F.struct(own(x["m"], x["r"]).alias("gone"), own(x["r"], x["m"]).alias("new")))
    return pairs.withColumn("_d", found).withColumns({"gone": F.col("_d.gone"), "new": F.col("_d.new")}).drop("_d").filter((F.size("gone") <= most) & (F.size("new") <= most))


def correction_triples(
    pairs: DataFrame, key: str = "id", min_frequency: int = 5, min_consistency: float = 0.5, most: int = 15, strong: float = 0.3, weak: float = 0.15, candidates: int = 5, stop: tuple[str, ...] = W.ENGLISH_STOPWORDS,
    source_stop: tuple[str, ...] = W.GERMAN_STOPWORDS,
) -> DataFrame:
    """(de_term, en_correct, en_mt_error, frequency, consistency, de_association): what a word of the machine's gives way to, and the source word behind it.

    A pair (error, correction) counts if it is met ``min_frequency`` times and makes up ``min_consistency`` of the error's cases. Its source word is the one beside it most, if beside it in ``strong`` of its cases; else the first of
    the ``candidates`` most frequent ones of five letters or more, if in ``weak`` of them. Of the pairs of a source word the most frequent one stays. Ties go by consistency, then by alphabet.
    ``key`` names a row of ``pairs``. Words of a pair are multiplied out ``most`` by ``most`` at most; source words come in only for pairs that count already.
    """
    sets = differences(pairs, most, stop)
    total = sets.select(F.explode("gone").alias("en_mt_error")).groupBy("en_mt_error").agg(F.count("*").alias("total")).filter(F.col("total") >= min_frequency)
    both = sets.filter("size(new) > 0").select(key, F.explode("gone").alias("en_mt_error"), "new").join(total, "en_mt_error").select(key, "en_mt_error", "total", F.explode("new").alias("en_correct"))
    good = both.groupBy("en_mt_error", "en_correct", "total").agg(F.count("*").alias("frequency")).withColumn("consistency", F.col("frequency") / F.col("total"))
    good = good.filter((F.col("frequency") >= min_frequency) & (F.col("consistency") >= min_consistency)).drop("total")
    source = sets.select(key, F.filter(without(lower_words("src"), source_stop), lambda w: F.length(w) >= 4).alias("source"))
    beside = both.drop("total").join(good, ["en_mt_error", "en_correct"]).join(source, key)
    counts = beside.select("en_mt_error", "en_correct", "frequency", "consistency", F.explode("source").alias("de_term")).groupBy("en_mt_error", "en_correct", "frequency", "consistency", "de_term").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("en_mt_error", "en_correct").orderBy(F.desc("n"), "de_term"))
    share = F.col("n") / F.col("frequency")
    ranked = counts.withColumn("k", place).filter(F.col("k") <= candidates).withColumn("de_association", share)
    fits = ((F.col("k") == 1) & (share >= strong)) | ((F.length("de_term") >= 5) & (share >= weak))
    picked = ranked.filter(fits).groupBy("en_mt_error", "en_correct", "frequency", "consistency").agg(F.min(F.struct("k", "de_term", "de_association")).alias("b"))
    rows = picked.select("b.de_term", "en_correct", "en_mt_error", "frequency", "consistency", "b.de_association")
    strongest = F.row_number().over(Window.partitionBy("de_term").orderBy(F.desc("frequency"), F.desc("consistency"), "en_mt_error", "en_correct"))
    return rows.withColumn("k", strongest).filter("k = 1").drop("k")


def bigram_corrections(pairs: DataFrame, most: int = 10, min_total: int = 5, min_together: int = 3, min_consistency: float = 0.4, stop: tuple[str, ...] = W.ENGLISH_STOPWORDS) -> DataFrame:
    """(mt_bigram, ref_bigram, frequency, consistency): word pairs of the machine's with the reference's that they give way to most; pairs of stop words alone don't count."""
    stops = F.array(*[F.lit(w) for w in stop])
    grams = lambda c: once(words(F.lower(F.coalesce(F.col(c), F.lit("")))), bigrams)
    telling = lambda c: F.filter(c, lambda g: F.exists(F.split(g, " "), lambda w: ~F.array_contains(stops, w)))
    both = F.struct(grams("mt").alias("m"), grams("ref").alias("r"))
    sets = pairs.select(once(both, lambda x: F.struct(telling(F.array_except(x["m"], x["r"])).alias("gone"), telling(F.array_except(x["r"], x["m"])).alias("new"))).alias("d")).select("d.*")
    sets = sets.filter((F.size("gone") <= most) & (F.size("new") <= most))
    one = sets.select(F.explode("gone").alias("mt_bigram"), "new")
    total = one.groupBy("mt_bigram").agg(F.count("*").alias("total")).filter(F.col("total") >= min_total)
    counts = one.join(total, "mt_bigram").select("mt_bigram", "total", F.explode("new").alias("ref_bigram")).groupBy("mt_bigram", "total", "ref_bigram").agg(F.count("*").alias("frequency"))
    best = counts.groupBy("mt_bigram", "total").agg(F.min(F.struct((-F.col("frequency")).alias("n"), "ref_bigram")).alias("b"))
    rows = best.select("mt_bigram", "b.ref_bigram", (-F.col("b.n")).alias("frequency"), (-F.col("b.n") / F.col("total")).alias("consistency"))
    return rows.filter((F.col("frequency") >= min_together) & (F.col("consistency") >= min_consistency))
