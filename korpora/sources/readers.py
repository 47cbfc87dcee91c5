"""Readers of the engine's input formats, as DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpora.functions.lexicons import SUBJECT_DOMAINS
from korpora.operators.corpus import strip

WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0), line of a text file. A split's offset in the file orders the splits; their line counts are summed up, so no task sees the whole file."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = sizes.select("block", "first", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "block").select((F.col("before") + F.col("at") - F.col("first")).alias("line_no"), F.col("value").alias("line"))


def paragraphs(spark: SparkSession, path: str, longer_than: int = 10) -> DataFrame:
    """doc_name, idx, text of the paragraphs of .docx files: trimmed, and kept if longer than ``longer_than`` (0: all that aren't empty)."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    root = ElementTree.fromstring(z.read("word/document.xml"))
                texts = ("".join(t.text or "" for t in p.iter(f"{WORD_NS}t")).strip() for p in root.iter(f"{WORD_NS}p"))
                out += [(name.rsplit("/", 1)[-1], i, t) for i, t in enumerate(x for x in texts if len(x) > longer_than)]
            yield pd.DataFrame(out, columns=["doc_name", "idx", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "doc_name string, idx int, text string")


def document_texts(rows: DataFrame, separator: str = "\n") -> DataFrame:
    """doc_name, text: a document's paragraphs joined in order."""
    parts = rows.groupBy("doc_name").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("p"))
    return parts.select("doc_name", F.array_join(F.transform("p", lambda x: x["text"]), separator).alias("text"))


def joined_sentences(rows: DataFrame, longer_than: int = 10) -> DataFrame:
    """doc_name, idx, sentence: a document's paragraphs joined by spaces, then cut where a capital follows a full stop."""
    parts = F.split(F.col("text"), r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])")
    kept = F.filter(F.transform(parts, strip), lambda s: F.length(s) > longer_than)
    return document_texts(rows, " ").select("doc_name", F.posexplode(kept).alias("idx", "sentence"))


def sentences_by_paragraph(rows: DataFrame, longer_than: int = 10) -> DataFrame:
    """doc_name, paragraph, idx, sentence: each paragraph cut on its own, brackets open a sentence too; no sentence crosses a paragraph."""
    kept = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+(?=[A-ZÄÖÜ\[])"), strip), lambda s: F.length(s) > longer_than)
    return rows.filter(F.length("text") > longer_than).select("doc_name", F.col("idx").alias("paragraph"), F.posexplode(kept).alias("idx", "sentence"))


def parallel_text(spark: SparkSession, left: str, right: str, skip: int = 0, most: int | None = None) -> DataFrame:
    """line_no, src, ref of two line-aligned files; ``most`` counts lines after ``skip``."""
    a, b = numbered_lines(spark, left), numbered_lines(spark, right)
    rows = a.withColumnRenamed("line", "src").join(b.withColumnRenamed("line", "ref"), "line_no").filter(F.col("line_no") >= skip)
    rows = rows.select("line_no", strip(F.col("src")).alias("src"), strip(F.col("ref")).alias("ref"))
    return rows if most is None else rows.orderBy("line_no").limit(most)


def line_counts_agree(spark: SparkSession, left: str, right: str) -> tuple[int, int, bool]:
    n, m = spark.read.text(left).count(), spark.read.text(right).count()
    return n, m, n == m


def patents(spark: SparkSession, path: str, ipc_prefix: str = "", needed: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Text columns of a CSV with header, filtered by class prefix and by columns that may not be empty."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if ipc_prefix:
        rows = rows.filter(F.col("ipc_code").startswith(ipc_prefix))
    for c in needed:
        rows = rows.filter(F.coalesce(strip(F.col(c)), F.lit("")) != "")
    return rows if most is None else rows.limit(most)


def domain_of(subject):
    """The domain of the first key, in the map's order, that the subject contains."""
    out = None
    for key, name in SUBJECT_DOMAINS:
        hit = F.upper(subject).contains(key)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(out, F.lit("general"))


def term_base(spark: SparkSession, path: str) -> DataFrame:
    """de_term, en_term, domain of a TBX file: every German with every English term of an entry; languages by substring."""
    schema = "descrip array<struct<_VALUE string, _type string>>, langSet array<struct<`_lang` string, `_xml:lang` string, tig array<struct<term string>>, ntig array<struct<termGrp struct<term string>>>, term array<string>>>"
    rows = spark.read.format("xml").option("rowTag", "termEntry").schema(schema).load(path)
    terms = lambda code: F.flatten(F.transform(F.filter("langSet", lambda s: F.lower(F.coalesce(s["_xml:lang"], s["_lang"])).contains(code)), lambda s: F.concat(F.coalesce(s["term"], F.array()), F.transform(F.coalesce(s["tig"], F.array()), lambda t: t["term"]), F.transform(F.coalesce(s["ntig"], F.array()), lambda t: t["termGrp"]["term"]))))
    subject = F.array_join(F.transform(F.filter("descrip", lambda d: d["_type"] == "subjectField"), lambda d: d["_VALUE"]), ";")
    return rows.select(domain_of(F.coalesce(subject, F.lit(""))).alias("domain"), F.explode(terms("de")).alias("de_term"), terms("en").alias("_e")).select("de_term", F.explode("_e").alias("en_term"), "domain")


def sniffed_terms(spark: SparkSession, path: str) -> DataFrame:
    """de_term, en_term of a CSV whose header names the languages."""
    rows = spark.read.csv(path, header=True)
    find = lambda name, code: next((c for c in rows.columns if name in c.lower() or c.lower().strip() == code), None)
    de, en = find("german", "de"), find("english", "en")
    if not (de and en):
        raise ValueError(f"no German and English columns in {rows.columns}")
    return rows.select(F.trim(f"`{de}`").alias("de_term"), F.trim(f"`{en}`").alias("en_term")).filter("de_term <> '' AND en_term <> ''")


def fields(line, n: int):
    return F.get(F.split(line, "\t"), n)


def custom_terms(spark: SparkSession, path: str, header: str = "always") -> DataFrame:
    """de_term, en_term, domain of a TSV; its first line is dropped, whatever it holds, unless ``header`` is "never"."""
    rows = numbered_lines(spark, path)
    rows = rows if header == "never" else rows.filter("line_no > 0")
    return rows.filter(F.size(F.split("line", "\t")) >= 2).select(strip(fields("line", 0)).alias("de_term"), strip(fields("line", 1)).alias("en_term"), F.coalesce(strip(fields("line", 2)), F.lit("custom")).alias("domain"))


def glossary(spark: SparkSession, path: str, lower: bool = False, needs_both: bool = False) -> DataFrame:
    """de_term, en_term of a TSV; comments (#) and blank lines go, of equal terms the last counts."""
    rows = numbered_lines(spark, path).filter(~strip(F.col("line")).startswith("#") & (strip(F.col("line")) != "") & (F.size(F.split("line", "\t")) >= 2))
    de, en = strip(fields("line", 0)), strip(fields("line", 1))
    rows = rows.select("line_no", (F.lower(de) if lower else de).alias("de_term"), en.alias("en_term"))
    if needs_both:
        rows = rows.filter("de_term <> '' AND en_term <> ''")
    return rows.groupBy("de_term").agg(F.max_by("en_term", "line_no").alias("en_term"))


def headed_glossary(spark: SparkSession, path: str) -> DataFrame:
    """As ``glossary``, columns found by header: keys in lower case, values as they are."""
    lines = numbered_lines(spark, path)
    head = [c.strip() for c in lines.filter("line_no = 0").head().line.split("\t")]
    find = lambda *names: next(i for i, c in enumerate(head) if c in names)
    d, e = find("de_term", "German"), find("correct_en", "Correct EN", "en_term")
    rows = lines.filter("line_no > 0").select("line_no", F.lower(strip(fields("line", d))).alias("de_term"), strip(fields("line", e)).alias("en_term"))
    return rows.filter("de_term <> '' AND en_term <> ''").groupBy("de_term").agg(F.max_by("en_term", "line_no").alias("en_term"))


def pasted_glossary(spark: SparkSession, text: str) -> DataFrame:
    """de_term, en_term of pasted lines: terms between tabs, no comments; of equal terms the last counts. Lines of fewer than two fields are left out."""
    lines = [x.strip().split("\t") for x in text.strip().split("\n")]
    found = {x[0].strip(): x[1].strip() for x in lines if len(x) >= 2}
    return spark.createDataFrame(list(found.items()), "de_term string, en_term string")


def merged_glossary(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing entries win."""
    return existing.unionByName(new.join(existing.select("de_term"), "de_term", "left_anti"))


FEEDBACK = "timestamp timestamp, patent string, segment_id int, client_id string, de string, deepl string, corrected string, rating string, changed boolean, notes string, qe_rating_original string, qe_category_original string, source string"


def feedback_log(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSONL events; malformed lines are skipped, or fail if strict."""
    return spark.read.schema(FEEDBACK).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def first_feedback(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    """The first ``most`` events of a log in its order, the first of each patent and segment; malformed lines are skipped and don't count. Missing keys count as the same one."""
    lines = numbered_lines(spark, path).filter(strip(F.col("line")) != "")
    parsed = lines.select("line_no", F.from_json("line", f"{FEEDBACK}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e")).filter("e IS NOT NULL AND e._bad IS NULL")
    key = [F.coalesce(F.col(f"e.{c}").cast("string"), F.lit("")).alias(c) for c in ("patent", "segment_id")]
    first = parsed.groupBy(*key).agg(F.min("line_no").alias("line_no"))
    return parsed.join(first.select("line_no"), "line_no", "left_semi").orderBy("line_no").limit(most).select("e.*").drop("_bad")


def records(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Rows of a file with a header, all columns text: evaluation sheets (tabs) and the tracker (commas)."""
    return spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')


def all_feedback(pending: DataFrame, training: DataFrame) -> DataFrame:
    return pending.unionByName(training.filter("source = 'user_feedback'"), allowMissingColumns=True)


def proposals(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """JSON files of a folder by name, one proposal each; bad files are skipped."""
    schema = "rule_name string, target_prompt string, target_section string, rule_text string, severity string, rationale string, `_metadata` struct<status: string, pattern_type: string, pattern_count: int, catch_rate: double>, _bad string"
    texts = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("p"))
    rows = texts.filter("p IS NOT NULL AND p._bad IS NULL").select("file", "p.rule_name", "p.target_prompt", "p.rule_text", "p.severity", F.col("p._metadata.status").alias("status"))
    return (rows if status is None else rows.filter(F.col("status") == status)).orderBy("file")


def json_document(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The rows of an array inside a JSON document."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("r")).select("r.*")


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query on a SQLite file, read where the task runs; the file's bytes come through Spark's own reader."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for pdf in batches:
            for content in pdf.content:
                c = sqlite3.connect(":memory:")
                c.deserialize(bytes(content))
                yield from pd.read_sql_query(query, c, chunksize=10_000)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def catalog(spark: SparkSession) -> list[tuple[str, list[tuple[str, str]]]]:
    """Tables and views of the session with their columns and types, by name."""
    return [(t.name, [(c.name, c.dataType) for c in spark.catalog.listColumns(t.name)]) for t in sorted(spark.catalog.listTables(), key=lambda t: t.name)]
