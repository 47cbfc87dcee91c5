"""Text expressions: sentence splitting, tokens, bases. All are built-in functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sentence ends at . ! or ? before white space and one of these.
OPENERS = r"[A-ZÄÖÜ\[(]"
SENTENCE_BREAK = rf"(?<=[.!?])\s+(?={OPENERS})"
#: The same in squeezed text; it begins with a letter of its own, so most places are passed over at once.
SQUEEZED_BREAK = rf" (?<=[.!?] )(?={OPENERS})"
#: Unicode word; the flag is needed, since Java's \w is ASCII. Common letters come first, as the test for all others is slow.
WORD = r"(?U)[a-zA-Z0-9_\w]+"


def squeeze(text: Column) -> Column:
    """Trim, and one space for each run of white space."""
    return F.trim(F.regexp_replace(text, r"\s{2,}|[\t\n\x0B\f\r]", " "))  # single spaces stay as they are


def sentences(text: Column, longer_than: int = 15) -> Column:
    """Array of sentences of more than ``longer_than`` characters."""
    parts = F.transform(F.split(squeeze(text), SQUEEZED_BREAK), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside a lambda, or pushed down with a filter, an expression would be computed for each time it is named."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def split_sentences(docs: DataFrame, key: str = "doc_id", longer_than: int = 15) -> DataFrame:
    """(key, idx, sentence), idx from 0."""
    return docs.select(key, F.posexplode(sentences(F.col("text"), longer_than)).alias("idx", "sentence"))


def strip_suffix(word: Column, suffixes: tuple[str, ...], stem: int) -> Column:
    """Without the first of the suffixes that fits and leaves more than ``stem`` characters."""
    chain = word
    for s in reversed(suffixes):
        chain = F.when(word.endswith(s) & (F.length(word) > len(s) + stem), F.substring(word, 1, F.length(word) - len(s))).otherwise(chain)
    return chain


#: Stands for a full stop that ends no sentence; a private character, so it can't be met in a text.
STOP = chr(0xE000)


def protected(text: Column, abbreviations: tuple[str, ...]) -> Column:
    """Full stops of abbreviations hidden."""
    for a in abbreviations:
        text = F.replace(text, F.lit(a), F.lit(a.replace(".", STOP)))
    return text


def restored(text: Column) -> Column:
    return F.replace(text, F.lit(STOP), F.lit("."))


def guarded_sentences(text: Column, abbreviations: tuple[str, ...], markers: bool = False, longer_than: int = 15) -> Column:
    """As ``sentences``, but abbreviations, and on demand list markers (a. 1. iv.), end no sentence."""
    t = protected(squeeze(text), abbreviations)
    if markers:
        for p in (r"(?U)(?<!\w)([a-zA-Z0-9])\.\s", r"(?iU)(?<!\w)(ii|iii|iv|vi|vii|viii|ix|xi|xii)\.\s", r":\s+([a-zA-Z0-9])\.\s"):
            t = F.regexp_replace(t, p, (": " if p[0] == ":" else "") + "$1" + STOP + " ")
    parts = F.transform(F.split(t, SQUEEZED_BREAK), lambda s: F.trim(restored(s)))
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def paragraph_sentences(text: Column, abbreviations: tuple[str, ...], longer_than: int = 10) -> Column:
    """Sentences of a paragraph: its number ([0012]) goes, only capitals open a sentence, parts aren't trimmed."""
    t = protected(F.regexp_replace(text, r"^\[\d{4}\]\s*", ""), abbreviations)
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])"), restored), lambda s: F.length(s) > longer_than)


def without_bold(text: Column) -> Column:
    return F.regexp_replace(text, r"\*\*(.+?)\*\*", "$1")


def option_label(text: Column) -> Column:
    """The first word of an option's text."""
    return F.substring_index(text, " ", 1)


def listed(text: Column) -> Column:
    """Parts between commas or slashes, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.replace(text, F.lit("/"), F.lit(",")), ","), lambda x: F.trim(x)), lambda x: x != "")


def term_hint(pairs: Column) -> Column:
    """Text for a model: ' || terms: de=en; de=en', empty without pairs (structs de, en)."""
    return F.when(F.size(pairs) > 0, F.concat(F.lit(" || terms: "), F.array_join(F.transform(pairs, lambda p: F.concat(p["de"], F.lit("="), p["en"])), "; "))).otherwise("")
