r"""How the sources of a language diverge in their words: a sort-based audit.

Terms are ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z lower-cased. A language keeps the terms that at least ``least`` of its documents hold. A group
(lang, source) gives a kept term p = 1 + floor(10**9 * (count + 2) / (N + 2 V)); the language as a whole gives it its own. Divergence of two values is
floor((p - q)**2 / (p + q)). All arithmetic is in integers.

Plan: each task sorts what its documents hold by (language, term, source, document) and scans the runs: documents and occurrences of each (language, term, source). Only runs
are shuffled. They are repartitioned by (language, term, source) and sorted, and a scan adds up equal ones; a term in every document of a hot source is a run a task. The
sums are repartitioned by (language, term), sorted by source, and a second scan sees a term's sources side by side: it drops rare terms. A third scan over what is kept emits, for
each run, the terms' values and partial sums of the pairs of sources that share the term. What a pair gets from terms that one or both sources lack depends only on
that group's value for a count of zero, so it is added from the histogram of each group's values, and no source is paired with a term that it doesn't have.

Null text, lang and source count as ''. Each row is a document, so repeated rows count each; doc_id is not read. Groups without terms are paired too. Empty tables give no rows; other columns,
clashing names included, are left behind. Ties of value are ranked by the item's UTF-8 bytes. Exact while N + 2 V < 2**63 / 10**3.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpora.llm.common import chunks, mapped, stored

#: ASCII letters lower-cased, other ASCII characters as spaces, bytes of other characters as they are.
TERM_BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Bytes of one text that are taken apart at a time.
PART = 1 << 22
BLOCK = 16 << 20
UNIT = 10**9
PAIRS_HELD = 1 << 18
RUNS = "lang string, term string, source string, docs long, n long"
KEPT = "lang string, term string, source string, n long, total long, lead int"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    data = text.decode("utf-8", "replace").encode().translate(TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PART)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def document_runs(documents: DataFrame) -> DataFrame:
    """(lang, term, source, docs, n): runs of each task's blocks of documents, sorted by (lang, term, source, document)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in chunks(batches, BLOCK):
            number: dict[bytes, int] = {}
            groups: dict[tuple[str, str], int] = {}
            own, at, doc, counts = [], [], [], []
            for k, (text, lang, source) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True)):
                held: Counter = Counter()
                for part in terms(text):
                    held.update(part)
                own.append(np.fromiter((number.setdefault(t, len(number)) for t in held), np.int64, len(held)))
                counts.append(np.fromiter(held.values(), np.int64, len(held)))
                at.append(np.full(len(held), groups.setdefault((lang, source), len(groups)), np.int64))
                doc.append(np.full(len(held), k, np.int64))
            own, at, doc, counts = map(np.concatenate, (own, at, doc, counts))
            order = np.lexsort((doc, at, own))
            own, at, counts = own[order], at[order], counts[order]
            first = np.flatnonzero(np.diff(own, prepend=-1) | np.diff(at, prepend=-1))
            langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            yield {
                "lang": langs.take(pa.array(at[first])), "source": sources.take(pa.array(at[first])), "term": pa.array([t.decode() for t in number], pa.string()).take(pa.array(own[first])),
                "docs": np.diff(first, append=len(own)), "n": np.add.reduceat(counts, first) if len(first) else counts,
            }

    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    return mapped(documents.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), *named), work, RUNS)


def starts(table: pa.Table, *keys: str) -> np.ndarray:
    """Places at which a run of equal keys starts in sorted rows."""
    if not len(table):
        return np.zeros(0, np.int64)
    change = np.zeros(len(table), bool)
    change[0] = True
    for k in keys:
        c = table.column(k).combine_chunks()
        change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def added(table: pa.Table) -> pa.Table:
    """Rows of equal (lang, term, source) as one."""
    first = starts(table, "lang", "term", "source")
    sums = {c: pa.array(np.add.reduceat(table.column(c).to_numpy(), first) if len(first) else np.zeros(0, np.int64)) for c in ("docs", "n")}
    return pa.table({c: table.column(c).take(pa.array(first)) for c in ("lang", "term", "source")} | sums)


def whole_runs(batches: Iterator[pa.RecordBatch], reduce, *keys: str) -> Iterator[pa.Table]:
    """Sorted rows in tables that cut no run of equal keys; ``reduce`` shortens what is held back until its run ends."""
    held = None
    for b in batches:
        table = pa.Table.from_batches([b])
        table = reduce(pa.concat_tables([held, table]) if held is not None else table)
        if len(table):
            last = int(starts(table, *keys)[-1])
            if last:
                yield table.slice(0, last)
            held = table.slice(last)
    if held is not None:
        yield held


def summed(runs: DataFrame) -> DataFrame:
    """One row a (lang, term, source)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in whole_runs(batches, added, "lang", "term", "source"):
            yield {c: t.column(c).combine_chunks() for c in t.column_names}

    return mapped(runs.repartition(_partitions(runs), "lang", "term", "source").sortWithinPartitions("lang", "term", "source"), work, RUNS)


def kept_terms(sums: DataFrame, least: int) -> DataFrame:
    """(lang, term, source, n, total, lead) of terms in at least ``least`` documents of their language; total: occurrences in the language, lead: 1 in a term's first row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in whole_runs(batches, lambda x: x, "lang", "term"):
            first = starts(t, "lang", "term")
            size = np.diff(first, append=len(t))
            n = t.column("n").to_numpy()
            keep = np.repeat(np.add.reduceat(t.column("docs").to_numpy(), first) >= least, size)
            lead = np.zeros(len(t), np.int32)
            lead[first] = 1
            t = t.append_column("total", pa.array(np.repeat(np.add.reduceat(n, first), size))).append_column("lead", pa.array(lead)).filter(pa.array(keep))
            yield {c: t.column(c).combine_chunks() for c in ("lang", "term", "source", "n", "total", "lead")}

    return mapped(sums.repartition(_partitions(sums), "lang", "term").sortWithinPartitions("lang", "term", "source"), work, KEPT)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def share(count: str, total: str, vocabulary: str) -> str:
    """SQL for a term's p with ``count`` of ``total`` occurrences; null for an empty vocabulary."""
    return f"CASE WHEN {vocabulary} > 0 THEN 1 + CAST({UNIT} AS DECIMAL(12,0)) * CAST({count} + 2 AS DECIMAL(20,0)) DIV CAST({total} + 2 * {vocabulary} AS DECIMAL(20,0)) END"


def divergence(p: str, q: str) -> str:
    """SQL for floor((p - q)**2 / (p + q)) of two longs of at most 10**9 + 1."""
    return f"(({p}) - ({q})) * (({p}) - ({q})) DIV (({p}) + ({q}))"


def group_totals(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, v, lang_total, zero, total) of every group that occurs; zero: its value for a term that it lacks."""
    groups = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.sum(F.col("lead").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    return groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "v", "lang_total"]).withColumn("zero", F.expr(share("0L", "total", "v")))


def floor_divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shared_terms(values: DataFrame) -> DataFrame:
    """(lang, a, b, value): sums over the terms that both sources have of what their values add to f with zeros; ``values`` has lang, term, source, p, zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        group: dict[tuple[str, str], int] = {}
        held: dict[int, int] = {}

        def flushed() -> dict:
            names = list(group)
            a, b = [k >> 32 for k in held], [k & 0xFFFFFFFF for k in held]
            return {"lang": [names[x][0] for x in a], "a": [names[x][1] for x in a], "b": [names[x][1] for x in b], "value": list(held.values())}

        for t in whole_runs(batches, lambda x: x, "lang", "term"):
            run = np.repeat(np.arange(len(first := starts(t, "lang", "term"))), np.diff(first, append=len(t)))
            own = t.select(["lang", "source"]).combine_chunks()
            place = np.fromiter((group.setdefault(g, len(group)) for g in zip(own.column("lang").to_pylist(), own.column("source").to_pylist(), strict=True)), np.int64, len(t))
            p, zero = t.column("p").to_numpy(), t.column("zero").to_numpy()
            for lag in range(1, int(np.bincount(run).max(initial=0))):
                i = np.flatnonzero(run[lag:] == run[:-lag])
                j = i + lag
                f = floor_divergence(p[i], p[j]) - floor_divergence(p[i], zero[j]) - floor_divergence(zero[i], p[j]) + floor_divergence(zero[i], zero[j])
                pairs, inverse = np.unique(place[i] << 32 | place[j], return_inverse=True)
                sums = np.zeros(len(pairs), np.int64)
                np.add.at(sums, inverse, f)
                for k, v in zip(pairs.tolist(), sums.tolist(), strict=True):
                    held[k] = held.get(k, 0) + v
                if len(held) > PAIRS_HELD:
                    yield flushed()
                    held.clear()
        yield flushed()

    rows = values.select("lang", "term", "source", "p", "zero").repartition(_partitions(values), "lang", "term").sortWithinPartitions("lang", "term", "source")
    return mapped(rows, work, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audited(documents: DataFrame, least: int = 10, ranks: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the divergence of a group from every other source of its language, summed over all kept terms. Part ``term``: the
    group's terms that it has more of than its language, ``ranks`` of them. Ranks go from 1 by value, ties by item."""
    kept = stored(kept_terms(summed(document_runs(documents)), least), "audit-terms")
    totals = stored(group_totals(documents, kept), "audit-groups")
    values = kept.withColumnRenamed("total", "in_lang").join(totals, ["lang", "source"]).withColumns({"p": F.expr(share("n", "total", "v")), "q": F.expr(share("in_lang", "lang_total", "v"))})
    own = values.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(divergence("p", "q")).alias("value"))
    others = totals.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    spread = values.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("terms"))
    alone = spread.join(others, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.expr(f"terms * ({divergence('p', 'other')} - {divergence('zero', 'other')})")).alias("value"))
    empty = totals.join(others, "lang").filter("source <> item").select("lang", "source", "item", F.expr(f"CASE WHEN v = 0 THEN 0L ELSE v * ({divergence('zero', 'other')}) END").alias("value"))
    both = shared_terms(values)
    turned = lambda df, a, b: df.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), "value")
    parts = [empty, alone, turned(alone, "item", "source"), turned(both, "a", "b"), turned(both, "b", "a")]
    pairs = parts[0]
    for x in parts[1:]:
        pairs = pairs.unionAll(x)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionAll(own.withColumn("rank", place).filter(F.col("rank") <= ranks))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS in_lang FROM o GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(total), 0)::HUGEINT AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2) USING (lang, source) GROUP BY 1, 2),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(in_lang)::HUGEINT AS lang_total FROM k GROUP BY 1),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v))::HUGEINT AS p, (1 + 1000000000::HUGEINT * (in_lang + 2) // (lang_total + 2 * v))::HUGEINT AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""
