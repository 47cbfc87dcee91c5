"""Token tables: a parser as a provider, clause features over heads, nouns by tag and adjacent nouns.

A token table has doc_id, idx, i (from 0 without gaps in a sentence), text, pos, tag, dep, head_i (itself for a root). ``rule_parsed`` makes one from sentences by word lists, endings and neighbours, without a model; tables of a
statistical parser have the same columns. Everything happens within a sentence: one shuffle by sentence serves the windows and the arrays after them.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpora.functions import lexicons as W
from korpora.functions.arrays import lengths_of, list_of, slices
from korpora.operators.structure import CLAUSE_DEPS, scored

KEYS = ["doc_id", "idx"]
TOKEN = r"(?U)[a-zA-Z0-9_\w]+|[.,;:!?]"
#: Partitions of tokens for each one of sentences.
MORE = 8
VERBAL, NOMINAL = ("VERB", "AUX"), ("NOUN", "PROPN")

# ---- a parser by rules ----

SCONJ = ("dass", "weil", "wenn", "obwohl", "that", "as", "when", "que", "si", "comme", "por")
DET = ("der", "die", "das", "den", "dem", "ein", "eine", "einer", "the", "a", "an", "le", "la", "les", "un", "une", "el", "los", "las", "del")
AUX = ("ist", "sind", "war", "is", "are", "was", "est", "sont", "es", "son")
RELATIVE = ("der", "die", "das", "dem", "den", "dessen", "deren", "denen")
PARTICIPLE, PRESENT = "^(ge|an|er|ver).*(te|ten|ter|tes|tem)$", "end(e|en|er|es|em)?$"
NOUN_ENDS, VERB_ENDS = "(ung|heit|keit|tion|ment|ness|dad|ción|eur)$", "(en|ed|ing|er|ar|t)$"


#: Values of pos and dep that the rules give, by number.
POS = ("X", "PUNCT", "SCONJ", "PRON", "DET", "AUX", "ADJ", "NOUN", "VERB")
DEPS = ("mo", "ROOT", "punct", "cp", "rc", "oc", "cj", "sb", "oa", "nk")
#: What a word tells by itself, a bit each.
WORD_BITS = ("punct", "sconj", "relative", "det", "aux", "participle", "present", "capital", "noun_end", "verb_end", "long", "comma", "stop", "welch")


def told(word: str) -> int:
    """Bits of ``WORD_BITS``."""
    low, first = word.lower(), word[:1]
    found = (
        word in (".", ",", ";", ":", "!", "?"), low in SCONJ, low in RELATIVE, low in DET, low in AUX, re.search(PARTICIPLE, low), re.search(PRESENT, low), first == first.upper() and first != first.lower(), re.search(NOUN_ENDS, low), re.search(VERB_ENDS, low), len(word) > 4,
        word == ",", word in (".", ";"), low.startswith("welch"),
    )
    return sum(1 << k for k, x in enumerate(found) if x)


class Places:
    """Sentences laid end to end: the place of each token among all, its sentence's first place and the one after its last."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.size = lengths, int(lengths.sum())
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        self.sentence = np.repeat(np.arange(len(lengths)), lengths)
        self.at = np.arange(self.size)
        self.first, self.last = self.start[self.sentence], self.end[self.sentence]

    def before(self, mark: np.ndarray) -> np.ndarray:
        """The last marked place up to each one; too small if it is of an earlier sentence."""
        return np.maximum.accumulate(np.where(mark, self.at, -1))

    def after(self, mark: np.ndarray, least: int) -> np.ndarray:
        """The first marked place at least so many on; too large if it is of a later sentence."""
        ahead = np.minimum.accumulate(np.where(mark, self.at, self.size)[::-1])[::-1]
        return np.append(ahead, np.full(least, self.size))[least:] if least else ahead


def by_rules(words: pa.Array, s: Places) -> dict[str, np.ndarray]:
    """pos, dep (numbers), head (a place among all) and the bits of words, for the words of sentences laid end to end."""
    coded = words.dictionary_encode()
    bits = np.array([told(w) for w in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()]
    is_ = {name: (bits >> k & 1).astype(bool) for k, name in enumerate(WORD_BITS)}
    prev = np.append(False, is_["comma"][:-1]) & (s.at > s.first)
    number = {name: k for k, name in enumerate(POS)}
    checks = [
        (is_["punct"], "PUNCT"), (is_["sconj"], "SCONJ"), (prev & is_["relative"], "PRON"), (is_["det"], "DET"), (is_["aux"], "AUX"), (is_["long"] & (is_["participle"] | is_["present"]), "ADJ"),
        ((s.at > s.first) & is_["capital"] | is_["noun_end"], "NOUN"), (is_["long"] & is_["verb_end"], "VERB"),
    ]
    pos = np.select([c for c, _ in checks], [number[name] for _, name in checks], 0)
    of = lambda *names: np.isin(pos, [number[x] for x in names])
    verb, opener, noun, hung = of(*VERBAL), of("SCONJ", "PRON"), of("NOUN"), of("DET", "ADJ")
    root = s.after(verb, 0)[s.first]
    root = np.where(root < s.last, root, s.first)
    earlier = lambda mark: np.append(-1, s.before(mark)[:-1])
    o, v, n = earlier(opener), earlier(verb), s.after(noun, 1)
    has_o = o >= s.first
    is_root = s.at == root
    head = np.select(
        [is_root, of("PUNCT"), opener | verb, noun, hung, s.at == s.first],
        [s.at, root, np.where(has_o, o, root), np.where(v >= s.first, v, root), np.where(n < s.last, n, root), root], s.at - 1,
    )
    name = {x: k for k, x in enumerate(DEPS)}
    dep = np.select(
        [is_root, of("PUNCT"), of("SCONJ"), of("PRON"), verb, noun, hung],
        [name["ROOT"], name["punct"], name["cp"], name["rc"], np.where(has_o, name["oc"], name["cj"]), np.where(s.at < root, name["sb"], name["oa"]), name["nk"]], name["mo"],
    )
    return {"pos": pos, "dep": dep, "head": head, "prev": prev} | {f"is_{x}": is_[x] for x in WORD_BITS}


def marks_of_rules(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``MARKS`` of tokens that ``by_rules`` parsed."""
    pos = lambda *names: np.isin(p["pos"], [POS.index(x) for x in names if x in POS])
    dep = lambda *names: np.isin(p["dep"], [DEPS.index(x) for x in names if x in DEPS])
    det = dep("nk") & pos("DET")
    return {
        "opens": dep(*CLAUSE_DEPS) | pos("SCONJ"), "opener": pos("SCONJ") | dep("rc") & pos("PRON", "DET"), "relative": dep("rc") | p["is_welch"] & dep("sb", "oa"), "pattern": p["prev"] & p["is_relative"] & pos("PRON", "DET"), "verbal": pos(*VERBAL), "nominal": pos(*NOMINAL),
        "stop": p["is_stop"], "comma": p["is_comma"], "part": pos("ADJ") & p["is_participle"], "present": pos("ADJ") & p["is_present"], "det_a": det, "det_b": det, "root": dep("ROOT"),
    }


#: What the features need to know of a token, a bit each.
MARKS = ("opens", "opener", "relative", "pattern", "verbal", "nominal", "stop", "comma", "part", "present", "det_a", "det_b", "root")
MADE = ("n_tokens", "clause_depth", "max_verb_final_span", "n_verb_final_clauses", "n_relative_clauses", "n_participial_constructions", "max_participial_span", "vorfeld_length")


def measured(head: np.ndarray, is_: dict[str, np.ndarray], s: Places) -> dict[str, np.ndarray]:
    """Features of sentences laid end to end; ``head`` is a place among all.

    Depths by pointer doubling: after k rounds a token points 2**k ancestors up and knows how many on the way open a clause, so as many rounds as the longest sentence's length has bits serve any depth.
    """
    count = len(s.lengths)
    p, n = head, np.where(head == s.at, 0, is_["opens"][head])
    for _ in range(int(np.ceil(np.log2(max(2, s.lengths.max(initial=0)))))):
        p, n = p[p], n + n[p]
    per = lambda rows, values: greatest(rows, values, count)
    whole = head[p] == p
    out = {"n_tokens": s.lengths, "clause_depth": per(s.sentence[whole], n[whole])}
    x = np.flatnonzero(is_["opener"])
    stop = np.minimum(np.minimum(s.after(is_["stop"], 1)[x], s.after(is_["comma"], 4)[x]), s.last[x])
    verb = s.before(is_["verbal"])[stop - 1]
    fits = (verb >= s.first[x]) & (verb - x > 2)
    out |= {"max_verb_final_span": per(s.sentence[x[fits]], (verb - x)[fits]), "n_verb_final_clauses": np.bincount(s.sentence[x[fits]], minlength=count)}
    out["n_relative_clauses"] = np.maximum(np.bincount(s.sentence[is_["relative"]], minlength=count), np.bincount(s.sentence[is_["pattern"]], minlength=count) > 0)
    rows, widths = [], []
    for kind, det in (("part", "det_a"), ("present", "det_b")):
        first = np.full(s.size, s.size)
        d = np.flatnonzero(is_[det] & (head != s.at))[::-1]
        first[head[d]] = d  # backwards, so the first one stays
        y = np.flatnonzero(is_[kind] & is_["nominal"][head])
        y = y[y - first[head[y]] > 2]
        rows.append(s.sentence[y])
        widths.append(y - first[head[y]])
    rows, widths = np.concatenate(rows), np.concatenate(widths)
    out |= {"n_participial_constructions": np.bincount(rows, minlength=count), "max_participial_span": per(rows, widths)}
    roots = np.flatnonzero(is_["root"])[::-1]
    field = np.zeros(count, np.int64)
    field[s.sentence[roots]] = np.where(is_["verbal"][roots], roots - s.first[roots], 0)
    return out | {"vorfeld_length": field}


def greatest(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """The greatest value of each row, at least 0."""
    out = np.zeros(count, np.int64)
    np.maximum.at(out, rows, values)
    return out


def struct_of(columns: dict[str, np.ndarray]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns.values()], list(columns))


FEATURE_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in MADE])
TOKEN_TYPE = T.StructType([T.StructField("pos", T.ByteType()), T.StructField("dep", T.ByteType()), T.StructField("head_i", T.IntegerType()), T.StructField("participle", T.BooleanType())])


@F.arrow_udf(FEATURE_TYPE)
def features_of_words(words: pa.Array) -> pa.Array:
    """Features of sentences, given as arrays of words, as the rules parse them."""
    made = []
    for a, b in slices(words):
        part = words.slice(a, b - a)
        s = Places(lengths_of(part))
        p = by_rules(part.flatten(), s)
        made.append(struct_of(measured(p["head"], marks_of_rules(p), s)))
    return pa.concat_arrays(made)


@F.arrow_udf(FEATURE_TYPE)
def features_of_tokens(heads: pa.Array, marks: pa.Array) -> pa.Array:
    """Features of sentences, given as arrays of heads and of marks."""
    made = []
    for a, b in slices(heads):
        part = heads.slice(a, b - a)
        s = Places(lengths_of(part))
        own = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        head = np.where((own >= 0) & (own < s.last - s.first), s.first + own, s.at)
        bits = marks.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
        made.append(struct_of(measured(head, {x: (bits >> k & 1).astype(bool) for k, x in enumerate(MARKS)}, s)))
    return pa.concat_arrays(made)


@F.arrow_udf(T.ArrayType(TOKEN_TYPE))
def parse(words: pa.Array) -> pa.Array:
    """Sentences, given as arrays of words, as the rules parse them."""
    made = []
    for a, b in slices(words):
        part = words.slice(a, b - a)
        s = Places(lengths_of(part))
        p = by_rules(part.flatten(), s)
        rows = pa.StructArray.from_arrays([pa.array(p["pos"].astype(np.int8)), pa.array(p["dep"].astype(np.int8)), pa.array((p["head"] - s.first).astype(np.int32)), pa.array(p["is_participle"])], ["pos", "dep", "head_i", "participle"])
        made.append(list_of(s.lengths, rows))
    return pa.concat_arrays(made)


def worded(sentences: DataFrame) -> DataFrame:
    """doc_id, idx and the words of sentences that have any."""
    return sentences.filter(F.col("sentence").rlike(TOKEN)).select(*KEYS, F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0)).alias("w"))


def rule_parsed(sentences: DataFrame) -> DataFrame:
    """Tokens with part of speech, tag, relation and head. Null and empty sentences have none.

    The first verb is the root (without one, the first token). Openers of clauses hang on the opener before them, verbs on the last opener, nouns on the last verb, determiners and adjectives on the next noun, other words on their
    neighbour to the left; so no chain runs in a circle.
    """
    # Sentences are dealt out before they are taken apart: what follows finds a sentence's tokens together, and no token is shuffled. A sentence's tokens take
    # about MORE times its room, so there are as many more partitions, and sorts stay in memory.
    n = MORE * int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = worded(sentences.repartition(n, *KEYS)).withColumn("p", parse("w")).select(*KEYS, F.posexplode(F.arrays_zip("w", "p")).alias("i", "x"))
    called = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    t = rows.select(*KEYS, "i", F.col("x.w").alias("text"), called(POS, F.col("x.p.pos")).alias("pos"), called(DEPS, F.col("x.p.dep")).alias("dep"), F.col("x.p.head_i").alias("head_i"), F.col("x.p.participle").alias("_part"))
    return t.select(*KEYS, "i", "text", "pos", F.when((F.col("pos") == "ADJ") & F.col("_part"), "ADJA|VerbForm=Part").otherwise(F.col("pos")).alias("tag"), "dep", "head_i")


# ---- features ----


def rule_features(sentences: DataFrame) -> DataFrame:
    """``clause_features`` of ``rule_parsed`` sentences, without a token table between: a sentence is a row throughout, and nothing is shuffled."""
    return worded(sentences).select(*KEYS, features_of_words("w").alias("f")).select(*KEYS, *[F.col(f"f.{c}").alias(c) for c in MADE])


def clause_features(parsed: DataFrame) -> DataFrame:
    """One row a sentence with the features of ``structure.scored``. Heads that are null or outside the sentence count as the token itself; tokens whose heads run in a circle have no depth."""
    pos, dep, low, text = F.col("pos"), F.col("dep"), F.lower("text"), F.col("text")
    det = (dep == "nk") & (pos == "DET")
    conditions = {
        "opens": dep.isin(*CLAUSE_DEPS) | (pos == "SCONJ"), "opener": (pos == "SCONJ") | ((dep == "rc") & pos.isin("PRON", "DET")), "relative": (dep == "rc") | (low.startswith("welch") & dep.isin("rc", "sb", "oa")),
        "pattern": low.isin(*RELATIVE) & pos.isin("PRON", "DET") & (dep != "det"), "verbal": pos.isin(*VERBAL), "nominal": pos.isin(*NOMINAL), "stop": text.isin(".", ";"), "comma": text == ",", "part": (pos == "ADJ") & F.col("tag").contains("Part"),
        "present": (pos == "ADJ") & low.rlike(PRESENT), "det_a": (dep == "det") | det, "det_b": dep.isin("det", "nk") & (pos == "DET"), "root": dep == "ROOT",
    }
    marks = sum((F.when(conditions[x], 1 << k).otherwise(0) for k, x in enumerate(MARKS)), F.lit(0))
    # The comma before a relative word is its neighbour's bit, so it is known once a sentence is one row.
    sent = parsed.select(*KEYS, "i", "head_i", marks.alias("m")).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("i", "head_i", "m"))).alias("t"))
    comma, pattern = 1 << MARKS.index("comma"), 1 << MARKS.index("pattern")
    after = lambda x, k: F.when((k > 0) & (F.get(F.col("t"), k - 1)["m"].bitwiseAND(F.lit(comma)) != 0), x["m"]).otherwise(x["m"].bitwiseAND(F.lit(~pattern)))
    made = sent.select(*KEYS, features_of_tokens(F.transform("t", lambda x: x["head_i"]), F.transform("t", after)).alias("f"))
    return made.select(*KEYS, *[F.col(f"f.{c}").alias(c) for c in MADE])


# Thresholds and texts of the factors.
FACTORS = (
    ("n_tokens > 35", "long sentence (%d tokens)", "n_tokens"), ("clause_depth >= 2", "clause depth %d", "clause_depth"), ("max_verb_final_span > 5", "verb-final span of %d tokens", "max_verb_final_span"),
    ("n_relative_clauses >= 2", "%d relative clauses", "n_relative_clauses"), ("n_participial_constructions > 0", "%d participial construction(s)", "n_participial_constructions"), ("vorfeld_length > 5", "long Vorfeld (%d tokens)", "vorfeld_length"),
)
HINTS = (
    ("clause_depth >= 2", "Clauses are nested %d deep: unpack them and say the main point first.", "clause_depth"), ("max_verb_final_span > 5", "A verb comes %d tokens late: move it to the front.", "max_verb_final_span"),
    ("n_relative_clauses >= 2", "%d relative clauses are stacked: make separate sentences.", "n_relative_clauses"), ("n_participial_constructions > 0", "%d extended attribute(s): turn them into relative clauses.", "n_participial_constructions"),
    ("vorfeld_length > 5", "%d tokens stand before the verb: put the subject first.", "vorfeld_length"),
)
LONG_HINT = ("n_tokens > 35", "The sentence has %d tokens: put the key information first.", "n_tokens")


def explained(features: DataFrame) -> DataFrame:
    """``structure.scored`` with figures: risk_factors as an array, translation_hint for all but low risks (a long sentence without any other hint gets one of its own)."""
    rows = scored(features).drop("risk_factors", "translation_hint")
    said = lambda rule: F.when(F.expr(rule[0]), F.format_string(rule[1], F.col(rule[2])))
    factors = F.when(F.col("n_tokens") < 4, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*map(said, FACTORS))))
    hint = F.coalesce(F.nullif(F.concat_ws(" ", *map(said, HINTS)), F.lit("")), said(LONG_HINT))
    return rows.withColumn("risk_factors", factors).withColumn("translation_hint", F.when(F.col("risk_level") != "low", hint))


def summary(rows: DataFrame) -> DataFrame:
    """One row over ``explained`` sentences; zeros without any."""
    level = lambda k: F.count_if(F.col("risk_level") == k)
    mean = lambda c, digits: F.coalesce(F.round(F.avg(c), digits), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("total_sentences"), mean("risk_score", 3).alias("avg_risk_score"), level("high").alias("high"), level("medium").alias("medium"), level("low").alias("low"), F.coalesce(F.round(F.try_divide(100.0 * level("high"), F.count("*")), 1), F.lit(0.0)).alias("high_risk_pct"),
        mean("n_tokens", 1).alias("avg_tokens"), F.coalesce(F.max("clause_depth"), F.lit(0)).cast("long").alias("max_clause_depth"), F.count_if(F.col("n_participial_constructions") > 0).alias("with_participials"), F.count_if(F.col("n_relative_clauses") > 0).alias("with_relative_clauses"),
    )


# ---- nouns ----


def tagged_nouns(parsed: DataFrame, stop: tuple[str, ...] = W.FUNCTION_WORDS, skip: tuple[str, ...] = W.SKIP_TOKENS, frozen: tuple[str, ...] = W.FROZEN_EXPRESSIONS) -> DataFrame:
    """(term, nouns, total): capitalised words, and runs of adjacent nouns, that are nouns in most of their occurrences.

    Gaps and islands: determiners, adjectives and nouns side by side are a chunk; its capitalised nouns, if two or more, count as a term of their own. Words of one letter, skipped tokens and function words don't count
    as words, and frozen expressions are no terms.
    """
    first = F.substring("text", 1, 1)
    capital = (first == F.upper(first)) & (first != F.lower(first))
    noun = F.col("pos").isin(*NOMINAL)
    lowered = tuple(sorted({w.lower() for w in stop}))
    single = parsed.filter(capital & (F.length("text") >= 2) & ~F.col("text").isin(*skip) & ~F.lower("text").isin(*lowered)).select(F.col("text").alias("term"), noun.cast("int").alias("noun"))
    island = F.col("i") - F.row_number().over(Window.partitionBy(*KEYS).orderBy("i"))
    chunk = parsed.filter(F.col("pos").isin("DET", "ADJ", *NOMINAL)).withColumn("chunk", island).filter(noun & capital)
    runs = chunk.groupBy(*KEYS, "chunk").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("w")).filter("size(w) >= 2")
    compound = runs.select(F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("term"), F.lit(1).alias("noun"))
    counts = single.unionByName(compound).groupBy("term").agg(F.sum("noun").alias("nouns"), F.count("*").alias("total"))
    return counts.filter((F.col("nouns") > 0.5 * F.col("total")) & ~F.col("term").isin(*frozen))


def united(*lists: tuple[str, ...]) -> tuple[str, ...]:
    """One stop list of several, in order, each word once."""
    return tuple(dict.fromkeys(reduce(lambda a, b: a + b, lists, ())))
