"""Batches for providers: fixed and overlapping, prompts, parsing of answers, retries."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNPARSED = "[PARSE ERROR — review manually]"


def batch_of(idx: Column, size: int) -> Column:
    return F.floor(idx / size)


def overlapping(rows: DataFrame, size: int = 50, overlap: int = 5) -> DataFrame:
    """Each row once for each batch that covers it: batch, start, local index, and whether the batch owns it (the earliest that covers it). Needs idx and n, the number of rows of its document."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the batch")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("long")
    low = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / step)).cast("long")
    high = F.least(last, F.floor(F.col("idx") / step).cast("long"))
    out = rows.withColumn("batch", F.explode(F.sequence(F.least(low, high), high))).withColumn("start", F.col("batch") * step)
    return out.withColumn("local", F.col("idx") - F.col("start")).withColumn("owner", F.col("batch") == F.least(low, high))


def prompt(rows: DataFrame, key: list[str], risk: str = "risk_level") -> DataFrame:
    """Numbered lines of a batch in order, with a note for risky sentences."""
    note = F.when(F.col(risk).isin("medium", "high") & F.col("hint").isNotNull(), F.format_string("\n   {STRUCTURAL NOTE (risk=%s, score=%.2f): %s}", F.col(risk), F.col("risk_score"), F.col("hint"))).otherwise("")
    line = F.concat(F.format_string("[%d] %s", F.col("local").cast("int") + 1, F.col("sentence")), note)
    parts = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("local", line.alias("line")))).alias("lines"))
    return parts.select(*key, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("prompt"))


def numbered(text: str, expected: int) -> list[str]:
    """Texts of a numbered answer, padded: bracketed numbers if most are there, else ``n.``, else lines."""
    found = {int(n): t.strip() for n, t in re.findall(r"\[(\d+)\]\s*(.*?)(?=\n\s*\[\d+\]|\Z)", text, re.S)}
    if len(found) < 0.8 * expected:
        dotted = {int(n): t.strip() for n, t in re.findall(r"(?m)^\s*(\d+)\.\s+(.*)$", text)}
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        found = dotted if len(dotted) >= 0.8 * expected else dict(enumerate(lines, 1))
    return [found.get(i) or UNPARSED for i in range(1, expected + 1)]


def json_rows(text: str, key: str = "rating") -> list[dict]:
    """Objects of an answer: fences off, the outer array, else a cut array closed again, else every balanced object with the key."""
    t = re.sub(r"^```\w*\s*|\s*```$", "", text.strip())
    start, end = t.find("["), t.rfind("]")
    tries = [t[start : end + 1]] if 0 <= start < end else []
    if start >= 0 and "}" in t[start:]:
        tries.append(t[start : t.rfind("}") + 1] + "]")
    for x in (*tries, t):
        try:
            out = json.loads(x)
        except ValueError:
            continue
        return [o for o in (out if isinstance(out, list) else [out]) if isinstance(o, dict)]
    out, depth, begin, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(t):
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c == "{":
            begin = i if depth == 0 else begin
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    o = json.loads(t[begin : i + 1])
                except ValueError:
                    continue
                if key in o:
                    out.append(o)
    return out


def json_object(text: str) -> dict | None:
    """The object of an answer: what a fence holds, else all, else from the first brace to the last; None if none parses."""
    fenced = re.search(r"```(?:json)?\s*\n?(.*?)\n?```", text, re.S)
    t = fenced[1].strip() if fenced else text.strip()
    for x in (t, t[t.find("{") : t.rfind("}") + 1] if "{" in t else ""):
        try:
            out = json.loads(x)
        except ValueError:
            continue
        if isinstance(out, dict):
            return out
    return None


#: Answers that are objects of Python at a time.
FEW = 64
PROPOSAL = "rule_name string, target_prompt string, target_section string, rule_text string, severity string, rationale string, parsed boolean"


def parsed_proposals(rows: DataFrame, *keys: str) -> DataFrame:
    """One rule proposal for each answer (columns response, type); an answer that holds no object becomes the text of a rule for its pattern's type."""
    fields = [f.split()[0] for f in PROPOSAL.split(", ")][:-1]

    kind = pa.struct([(f, pa.string()) for f in fields] + [("parsed", pa.bool_())])

    def parse(text: str | None, kind: str | None) -> dict:
        o = json_object(text or "")
        if o is None:
            return dict(zip(fields, (f"auto_{kind}", "qe", "UNKNOWN", (text or "").strip(), "minor", "failed to parse the answer"), strict=True)) | {"parsed": False}
        return {f: None if o.get(f) is None else str(o[f]) for f in fields} | {"parsed": True}

    def work(answers: pa.Array, types: pa.Array) -> pa.Array:
        # A few answers at a time are objects of Python; the rest of a batch stays in Arrow.
        parts = [(answers.slice(at, FEW), types.slice(at, FEW)) for at in range(0, len(answers), FEW)]
        return pa.concat_arrays([pa.array([parse(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], kind) for a, b in parts] or [pa.array([], kind)])

    return rows.select(*keys, F.arrow_udf(work, PROPOSAL)("response", "type").alias("p")).select(*keys, "p.*")


def parsed_numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, local, text) from answers: columns response, expected."""
    parse = F.pandas_udf(lambda r, n: pd.Series([numbered(x or "", int(k)) for x, k in zip(r, n, strict=True)]), "array<string>")
    return rows.select(*keys, F.posexplode(parse("response", "expected")).alias("local", "text"))


QE = "local int, rating string, error_category string, explanation string, suggestion string, confidence string"


def parsed_ratings(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each expected segment; what an answer lacks has the defaults."""

    def parse(r: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for text, k in zip(r, n, strict=True):
            got = json_rows(text or "")
            by = {int(o["index"]) if str(o.get("index", "")).isdigit() else i + 1: o for i, o in enumerate(got)}
            rows = []
            for i in range(1, int(k) + 1):
                o = by.get(i)
                rows.append({"local": i - 1, "rating": (o or {}).get("rating") or "minor", "error_category": (o or {}).get("error_category") or "other", "explanation": (o or {}).get("explanation") or ("" if o else "[QE FAILED]"), "suggestion": (o or {}).get("suggestion") or "", "confidence": (o or {}).get("confidence") or ("medium" if o else "low")})
            out.append(rows)
        return pd.Series(out)

    return rows.select(*keys, F.explode(F.pandas_udf(parse, f"array<struct<{QE.replace(' ', ':').replace(',:', ', ')}>>")("response", "expected")).alias("q")).select(*keys, "q.*")


def with_halving(call: Callable[[list], list | None], items: list, least: int = 3) -> list:
    """Answers of a provider; a failed batch is halved while it has more than ``least`` items, else its answers are None."""
    try:
        out = call(items)
        if out is not None and len(out) == len(items):
            return out
    except Exception:  # a provider may fail in any way; failures become fallback rows
        pass
    if len(items) <= least:
        return [None] * len(items)
    mid = len(items) // 2
    return with_halving(call, items[:mid], least) + with_halving(call, items[mid:], least)


class StubProvider:
    """Deterministic, offline: marks, rates and scores by checksum."""

    def translate(self, texts: list[str]) -> list[str]:
        return [f"<en> {t}" for t in texts]

    def evaluate(self, pairs: list[tuple[str, str]]) -> list[dict]:
        import zlib

        names = ("good", "good", "minor", "major", "critical")
        sums = [(zlib.crc32(s.encode()), zlib.crc32(m.encode())) for s, m in pairs]
        return [{"rating": names[s % 5], "error_category": "none" if s % 5 < 2 else "terminology", "confidence": ("high", "medium", "low")[m % 3], "score": s % 1000 / 1000} for s, m in sums]

    def propose(self, terms: list[str]) -> list[str]:
        return [f"en:{t}" for t in terms]


def provided(rows: DataFrame, provider: StubProvider, size: int = 20) -> DataFrame:
    """Adds translation, rating, confidence: a task calls the provider batch by batch; failures give fallback rows. Columns doc_id, idx, sentence."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sentences, translated, judged = pdf.sentence.tolist(), [], []
            for at in range(0, len(pdf), size):
                texts = sentences[at : at + size]
                own = [x if x is not None else UNPARSED for x in with_halving(provider.translate, texts)]
                translated += own
                judged += with_halving(provider.evaluate, list(zip(texts, own, strict=True)))
            # one table a batch of rows: one a call of the provider would cost more than the calls
            rating, confidence = [q["rating"] if q else "minor" for q in judged], [q["confidence"] if q else "low" for q in judged]
            yield pdf.assign(translation=translated, rating=rating, confidence=confidence)

    return rows.select("doc_id", "idx", "sentence").mapInPandas(work, "doc_id long, idx int, sentence string, translation string, rating string, confidence string")


def few_shot(examples: DataFrame, most: int = 200) -> DataFrame:
    """One row: examples as a numbered text block in order of ``rank``; texts are cut to ``most`` characters. Columns rank, source, translation, rating, explanation."""
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, most)
    line = F.concat(F.lit("Source: "), cut("source"), F.lit("\nTranslation: "), cut("translation"), F.lit("\nRating: "), F.col("rating"), F.when(cut("explanation") != "", F.concat(F.lit("\nWhy: "), cut("explanation"))).otherwise(""))
    parts = examples.agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("p"))
    return parts.select(F.array_join(F.transform("p", lambda x: F.concat(F.lit("Example "), x["rank"].cast("string"), F.lit(":\n"), x["line"])), "\n\n").alias("block"))


def layered_prompt(core: str, domain: str = "", glossary: list[tuple[str, str]] = (), custom: str = "", examples: str = "") -> str:
    """A prompt from its layers; empty ones leave nothing behind."""
    terms = "\n".join(f"{de} = {en}" for de, en in glossary)
    layers = (core, domain, f"Use these terms:\n{terms}" if terms else "", custom, examples)
    return "\n\n".join(x.strip() for x in layers if x and x.strip())


def cost(rows: DataFrame, text: str, per_million: float = 20.0) -> DataFrame:
    """One row: characters to be translated and their price."""
    return rows.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).withColumn("cost", F.col("chars") / 1e6 * per_million)
