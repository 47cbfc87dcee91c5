"""Glossaries as tables: terms found in sentences through an inverted index, at any size of the glossary.

A term fits a sentence if it is a substring of it (both in lower case), so it may start and end inside a word. The index has one code a term, eight of its bytes (all of a shorter term): of
those at its first places the ones that fewest terms share. Each place of a sentence is tried against a small table of bits, so that only places where a code may begin become rows; these are looked up in the index, and candidates are
verified by containment. The index has some bytes a term: it is sent to the sentences, so that only matches are shuffled, and above a number of bytes it is dealt into shards, each sent in a pass of its own.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from korpora.functions.places import BITS_A_CODE, MOST, coded, marks, placed
from korpora.functions.text import words
from korpora.operators.terms import compound_parts, lemma
from korpora.session import BROADCAST_BYTES, octets, written

KEYS = ["doc_id", "idx"]


def index_of(terms: DataFrame) -> DataFrame:
    """(key, code, n): the code by which each term is looked up, and its bytes."""
    spelt = terms.select("key").filter("key <> ''").distinct().mapInArrow(coded, "key string, code long, n int").distinct()
    weight = spelt.groupBy("code", "n").agg(F.count("*").alias("weight"))
    return spelt.join(weight, ["code", "n"]).groupBy("key").agg(F.min(F.struct("weight", "code", "n")).alias("r")).select("key", "r.code", "r.n")


def table_of(index: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """A table of bits with those of all codes set, and the power of two that its size is: bits are joined where the codes are, and at most 2 ** (``MOST`` - 6) numbers are collected."""
    bits = min(MOST, max(10, (BITS_A_CODE * rows - 1).bit_length()))
    joined = index.select("code").mapInArrow(marks(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(1 << bits - 6, np.int64)
    for r in joined.toLocalIterator():
        table[r.word] = r.bits
    return table, bits


def matches(sentences: DataFrame, terms: DataFrame, text: str = "sentence", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, idx, key): every term that is part of a sentence, once. ``terms`` has a column key, in lower case; blank keys fit nothing. Null sentences have no terms."""
    index = written(index_of(terms), "glossary-index")
    sizes = index.groupBy("n").agg(F.count("*").alias("rows")).collect()  # 1 to 8 bytes
    low = sentences.select(*KEYS, F.lower(text).alias("_low"))
    if not sizes:
        return low.select(*KEYS, F.col("_low").alias("key")).limit(0)
    shards = -(-octets(index, "key") // limit)
    table, bits = table_of(index, sum(r.rows for r in sizes))
    kept = StructType([*low.schema.fields, StructField("codes", ArrayType(LongType()))])
    spelt = low.filter("_low IS NOT NULL").mapInArrow(placed(sorted(r.n for r in sizes), table, bits), kept).select(*KEYS, "_low", F.explode("codes").alias("code"))
    own = index.select("code", "key")
    dealt = [own] if shards <= 1 else [own.filter(F.pmod(F.xxhash64("code"), F.lit(shards)) == k) for k in range(shards)]
    fit = [spelt.join(F.broadcast(part), "code").filter(F.col("_low").contains(F.col("key"))).select(*KEYS, "key") for part in dealt]
    return reduce(DataFrame.unionAll, fit).distinct()


def keyed(terms: DataFrame) -> DataFrame:
    """de, en and key, the trimmed source term in lower case; entries without a source term are left out."""
    return terms.select("de", "en", F.lower(F.trim("de")).alias("key")).filter("key <> ''")


def longest_matches(sentences: DataFrame, terms: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, idx, de, en, rank): the longest entries found in a sentence, up to ``most``; ties by de and en."""
    found = matches(sentences, own := keyed(terms)).join(own, "key")
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc(F.length("key")), "de", "en"))
    return found.select(*KEYS, "de", "en", place.alias("rank")).filter(F.col("rank") <= most)


def violations(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, idx, violations): entries whose source term is in ``src`` and whose target term is not in ``mt``, as de=en in order; pairs without any are left out."""
    found = matches(pairs, own := keyed(terms), "src").join(own, "key")
    bad = pairs.select(*KEYS, F.lower("mt").alias("_mt")).join(found, KEYS).filter(~F.coalesce(F.col("_mt").contains(F.lower("en")), F.lit(False)))
    return bad.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.concat("de", F.lit("="), "en"))).alias("violations"))


def sent_if_small(table: DataFrame, word: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A table of words and their options, written, and marked to be sent to all executors if its bytes, counted, are few; otherwise joins shuffle it."""
    kept = written(table, "glossary-words")
    texts = kept.select(word, F.array_join(F.transform("options", lambda o: F.concat(o["de"], F.coalesce(o["en"], F.lit("")))), "").alias("options"))
    return F.broadcast(kept) if octets(texts, word, "options") <= limit else kept


def lookup(sentences: DataFrame, terms: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, idx, rank, stage, de, en): a sentence's terms in three stages, up to ``most``, no target term twice.

    Stage 1: terms that are part of the sentence, longest first. Stage 2: word by word, single-word terms with the word's lemma. Stage 3: for words of eight letters or more, the first of its compound parts (in alphabetical order)
    whose lemma some term has. Each step takes the first of its entries whose target is still free, so a sentence's steps are folded in order; they are at most as many as the sentence has substrings.
    """
    own = keyed(terms).distinct()
    sentences = written(sentences.select(*KEYS, "sentence"), "glossary-sentences")  # read three times; splitting texts takes longer
    entries = F.array_sort(F.collect_list(F.struct("de", "en"))).alias("options")
    exact = own.groupBy("key").agg(entries)
    by_lemma = sent_if_small(own.filter(~F.col("key").contains(" ")).withColumn("lemma", lemma(F.col("key"))).groupBy("lemma").agg(entries), "lemma")
    first = matches(sentences, exact).join(exact, "key").select(*KEYS, F.struct(F.lit(1).alias("stage"), (-F.length("key")).alias("a"), F.col("key").alias("b"), "options").alias("step"))
    # What a word calls for doesn't depend on its place: it is looked up once a distinct word, by the word's own lemma and by those of its parts.
    used = sentences.select(*KEYS, F.posexplode(words(F.lower("sentence"))).alias("pos", "word"))
    parts = F.when(F.length("word") >= 8, F.transform(compound_parts(F.col("word")), lambda p: F.struct(F.lit(3).alias("stage"), p.alias("part")))).otherwise(F.array())
    spelt = used.select("word").distinct().select("word", F.explode(F.concat(F.array(F.struct(F.lit(2).alias("stage"), F.col("word").alias("part"))), parts)).alias("p")).select("word", "p.*")
    calls = spelt.withColumn("lemma", lemma(F.col("part"))).join(by_lemma, "lemma").groupBy("word", "stage").agg(F.min(F.struct("part", "options")).getField("options").alias("options"))
    later = used.join(sent_if_small(calls, "word"), "word").select(*KEYS, F.struct("stage", F.col("pos").alias("a"), F.lit("").alias("b"), "options").alias("step"))
    steps = first.unionByName(later).groupBy(*KEYS).agg(F.array_sort(F.collect_list("step")).alias("steps"))
    taken = "array<struct<stage:int,de:string,en:string>>"

    def take(done: Column, step: Column) -> Column:
        free = F.filter(step["options"], lambda o: ~F.exists(done, lambda t: F.lower(t["en"]) == F.lower(o["en"])))
        return F.when((F.size(done) < most) & (F.size(free) > 0), F.concat(done, F.array(F.struct(step["stage"].alias("stage"), free[0]["de"].alias("de"), free[0]["en"].alias("en"))))).otherwise(done)

    found = steps.select(*KEYS, F.posexplode(F.aggregate("steps", F.array().cast(taken), take)).alias("i", "t"))
    return found.select(*KEYS, (F.col("i") + 1).alias("rank"), "t.stage", "t.de", "t.en")
