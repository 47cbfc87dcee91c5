"""Report rows: lines of a segment with its errors, a summary, and texts cut into runs by error spans that may overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpora.functions.arrays import lengths_of, list_of, slices

#: From mild to grave.
SEVERITIES = ("minor", "major", "critical")
TRIAGE = (("PUBLISH", "Publish"), ("REVIEW", "Review"), ("FULL_EDIT", "Full Edit"))


def report_lines(segments: DataFrame, *keys: str) -> DataFrame:
    """keys, k, line: header, source, translation, the first translation if it was changed, and the errors if there are any. k orders a segment's lines.

    Segments: keys, de, ape, deepl, triage, score, changed, skipped, n_glossary, error_spans (structs with text, severity, confidence). A null text is a blank one, a null flag is false, a null span list has no errors.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    spans = F.coalesce("error_spans", F.expr("filter(error_spans, x -> false)"))
    n = F.coalesce(F.size("error_spans"), F.lit(0))
    some = lambda count, text: F.when(count > 0, F.format_string(text, count)).otherwise("")
    header = F.concat(
        F.format_string("[%s] %s (QE: %.3f)", F.concat_ws(".", *[F.col(k).cast("string") for k in keys]), said("triage"), F.coalesce("score", F.lit(0.0)).cast("double")), F.when(yes("skipped"), "  • QE passthrough").when(yes("changed"), "  • APE corrected").otherwise(""),
        some(n, "  • %d errors detected"), some(F.coalesce("n_glossary", F.lit(0)), "  • %d glossary terms"),
    )
    errors = F.concat(F.lit("QE errors: "), F.array_join(F.transform(spans, lambda e: F.format_string("'%s' (%s, %.2f)", e["text"], e["severity"], F.coalesce(e["confidence"], F.lit(0.0)))), ", "))
    lines = F.array(header, F.concat(F.lit("DE: "), said("de")), F.concat(F.lit("EN: "), said("ape")), F.when(yes("changed"), F.concat(F.lit("DeepL original: "), said("deepl"))), F.when(n > 0, errors))
    return segments.select(*keys, F.posexplode(lines).alias("k", "line")).filter("line IS NOT NULL")


def report_summary(segments: DataFrame) -> DataFrame:
    """One row, one line: counts and whole percents, rounded down; no percents without segments."""
    count = {name: F.count_if(F.col("triage") == key) for key, name in TRIAGE} | {"APE Changed": F.count_if("changed"), "QE Passthrough": F.count_if("skipped")}
    total = F.count("*")
    parts = [F.format_string(f"{name}: %d (%d%%)", n, F.coalesce(F.floor(F.try_divide(100 * n, total)), F.lit(0))) for name, n in count.items()]
    return segments.agg(F.concat_ws("  |  ", F.format_string("Processed %d segments", total), *parts, F.format_string("Glossary forced: %d", F.count_if(F.coalesce("n_glossary", F.lit(0)) > 0))).alias("line"))


def annotated_runs(segments: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, start, end, severity, run: the text cut into the longest runs of one severity; where spans overlap the gravest counts, null is no error. Runs follow each other without gaps and make up the text.

    A sweep line: spans become events where a severity begins or ends, events at a place are added up, and running sums say what is open after each. A segment is a row throughout, and the events of many segments are sorted together in
    columns, so nothing is shuffled. Spans are cut at the ends of the text, a missing start or end is 0; empty ones, and ones without a known severity, count as none. Columns: ``text`` and error_spans (structs with start, end, severity).
    """
    code = lambda s: sum((F.when(s["severity"] == name, k + 1).otherwise(0) for k, name in enumerate(SEVERITIES)), F.lit(0))
    of = lambda f: F.coalesce(F.transform("error_spans", lambda s: F.coalesce(f(s).cast("int"), F.lit(0))), F.array().cast("array<int>"))
    rows = segments.filter(F.length(text) > 0).select(*keys, F.col(text).alias("_text"), F.explode(sweep(F.length(text), of(lambda s: s["start"]), of(lambda s: s["end"]), of(code))).alias("r"))
    named = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, SEVERITIES)), F.col("r.severity"))
    return rows.select(*keys, "r.start", "r.end", named.alias("severity"), F.substring("_text", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("run"))


RUN_TYPE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "severity")])


@F.arrow_udf(T.ArrayType(RUN_TYPE))
def sweep(sizes: pa.Array, starts: pa.Array, ends: pa.Array, severities: pa.Array) -> pa.Array:
    """Runs (start, end, severity) of texts of so many characters with their spans; severities are numbers, the gravest greatest, 0 is none."""
    made = []
    for x, y in slices(starts):
        size = sizes.slice(x, y - x).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lambda c: c.slice(x, y - x).flatten().to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        row = np.repeat(np.arange(len(size)), lengths_of(starts.slice(x, y - x)))
        base = np.cumsum(size + 1) - size - 1  # places of all texts in one row of numbers
        a, b, grave = np.clip(flat(starts), 0, size[row]), np.clip(flat(ends), 0, size[row]), flat(severities)
        live = (a < b) & (grave > 0)
        a, b, grave = a[live] + base[row[live]], b[live] + base[row[live]], grave[live]
        places = np.unique(np.concatenate([base, base + size, a, b]))
        worst = np.zeros(len(places), np.int64)
        for k in range(1, len(SEVERITIES) + 1):
            change = np.zeros(len(places), np.int64)
            np.add.at(change, np.searchsorted(places, a[grave == k]), 1)
            np.add.at(change, np.searchsorted(places, b[grave == k]), -1)
            worst[np.cumsum(change) > 0] = k
        text = np.searchsorted(base, places, "right") - 1
        closing = places == (base + size)[text]
        first = np.append(True, text[1:] != text[:-1])
        turn = np.flatnonzero(first | closing | (worst != np.append(0, worst[:-1])))
        begin, end = turn[:-1], turn[1:]
        begin, end = begin[~closing[begin]], end[~closing[begin]]
        own = text[begin]
        rows = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in (places[begin] - base[own], places[end] - base[own], worst[begin])], ["start", "end", "severity"])
        made.append(list_of(np.bincount(own, minlength=len(size)), rows))
    return pa.concat_arrays(made)
