"""Quality rules as a bitmask ledger, in built-in functions only.

Each document is measured once; each rule reads only the measurements and owns one bit. ``ledger`` stores the
measurements and the bits of the rules that fail. ``apply_policy`` then judges a ledger under a versioned policy (a mask
of rules), and ``ablation`` says by bitwise aggregation what each rule of a policy rejects, and what it alone rejects,
so policies can be compared without reading a text again.

A null text counts as empty: it has no words and fails the word count. Ids are carried along and never interpreted, so null
ids and repeated rows give a row each. An empty table gives no rows; columns that aren't kept, clashing names included, are left behind. Three-word windows are compared by 64-bit hashes within one text (a text of n
windows has a chance of n*n/2**65 of a false repeat).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def kept_length(text: Column, pattern: str) -> Column:
    """Number of characters left when those that match are taken out."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more, the first included: windows sorted by hash, equal neighbours marked."""

    def marked(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        again = lambda s: F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
        starts = bound(F.sort_array(windows), again)
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))).cast("long")

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(bound(words, marked))


def measured(documents: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the measurements of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(*keep, text.alias("_text"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHARACTER)).alias("_lines"))
    return rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        kept_length(F.col("_text"), SPACE).alias("word_chars"),
        kept_length(F.col("_text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        kept_length(F.col("_text"), r"[^A-Z]+").alias("n_capitals"),
        kept_length(F.col("_text"), r"[^!]+").alias("n_marks"),
    )


@dataclass(frozen=True)
class Rule:
    """One bit: the document fails if ``fails`` (SQL over the measurements) holds."""

    bit: int
    name: str
    fails: str


#: Bits are never given anew; a changed threshold is a new rule.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_words", "n_words > 100000"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(6, "repeated_lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(7, "capitals", "10 * n_capitals > 4 * word_chars"),
    Rule(8, "exclamation", "10 * n_marks > 4 * n_words"),
)
BASE = ("few_words", "repeated_windows")
#: Version of a policy: the rules it holds.
POLICIES = {1: BASE, 2: (*BASE, "many_words", "short_words", "long_words", "symbols", "repeated_lines", "capitals", "exclamation")}
#: The pipeline drops no document for being long.
POLICIES[3] = tuple(n for n in POLICIES[2] if n != "many_words")
CURRENT, PIPELINE = 2, 3


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in names)


def ledger(documents: DataFrame, *keep: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The kept columns, the measurements, and ``fail_bits``: every rule is evaluated once."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured(documents, *keep).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: int = CURRENT) -> DataFrame:
    """Adds ``kept``, false if any rule of the policy fails, and ``policy``."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0).withColumn("policy", F.lit(policy))


def ablation(entries: DataFrame, policy: int = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule, rejected, rejected_alone: what the policy would keep if it lost the rule. One pass, one row a rule."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long"))
    own = [r for r in rules if r.name in POLICIES[policy]]
    counts = [c for r in own for c in (F.count_if(failed.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"a{r.bit}"), F.count_if(failed == F.lit(1 << r.bit).cast("long")).alias(f"b{r.bit}"))]
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"a{r.bit}").alias("rejected"), F.col(f"b{r.bit}").alias("rejected_alone")) for r in own])
    return entries.agg(*counts).select(F.inline(rows))


def judge(documents: DataFrame, policy: int = CURRENT) -> DataFrame:
    """doc_id, the measurements, fail_bits, base_failed, kept of every document."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return apply_policy(ledger(documents, "doc_id"), policy).withColumn("base_failed", base)


SQL = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
two AS (SELECT rid, g FROM g GROUP BY rid, g HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM g JOIN two USING (rid, g), (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals, length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_marks FROM w LEFT JOIN covered USING (rid)),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask(BASE)} <> 0 AS base_failed, fail_bits & {mask(POLICIES[CURRENT])} = 0 AS kept, fail_bits FROM b"""
