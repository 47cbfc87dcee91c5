import json
import sqlite3
import zipfile

import pytest

from korpora.sources import readers as R
from korpora.sources import writers as W


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_numbered_lines_of_many_splits(spark, tmp_path):
    p = write(tmp_path / "x.txt", "".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = {r.line_no: r.line for r in R.numbered_lines(spark, p).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == {i: f"line {i}" for i in range(5000)}


def test_docx(spark, tmp_path):
    ns = R.WORD_NS[1:-1]
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("kurz", "Ein langer Absatz.", "", "Noch ein Absatz hier."))
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    p = R.paragraphs(spark, str(tmp_path / "a.docx"))
    assert [tuple(r) for r in p.orderBy("idx").collect()] == [("a.docx", 0, "Ein langer Absatz."), ("a.docx", 1, "Noch ein Absatz hier.")]
    assert R.paragraphs(spark, str(tmp_path / "a.docx"), 0).count() == 3
    assert R.document_texts(p, " ").head().text == "Ein langer Absatz. Noch ein Absatz hier."


def test_parallel_text(spark, tmp_path):
    a, b = write(tmp_path / "c.de", "eins\nzwei\ndrei\n"), write(tmp_path / "c.en", "one \ntwo\nthree\n")
    assert [tuple(r) for r in R.parallel_text(spark, a, b, skip=1, most=1).collect()] == [(1, "zwei", "two")]
    assert R.line_counts_agree(spark, a, b) == (3, 3, True)


def test_term_files(spark, tmp_path):
    tbx = """<martif><text><body><termEntry id="1"><descrip type="subjectField">Medical devices</descrip><langSet xml:lang="de"><tig><term>Herz</term></tig></langSet><langSet xml:lang="en-GB"><tig><term>heart</term></tig><tig><term>cor</term></tig></langSet></termEntry>
<termEntry id="2"><langSet xml:lang="de"><tig><term>Rad</term></tig></langSet><langSet xml:lang="fr"><tig><term>roue</term></tig></langSet></termEntry></body></text></martif>"""
    rows = R.term_base(spark, write(tmp_path / "i.tbx", tbx)).collect()
    assert sorted(map(tuple, rows)) == [("Herz", "cor", "medical"), ("Herz", "heart", "medical")]
    assert R.sniffed_terms(spark, write(tmp_path / "w.csv", "id,German term,English term\n1,Welle,shaft\n2,,x\n")).collect()[0][:] == ("Welle", "shaft")
    assert sorted(map(tuple, R.custom_terms(spark, write(tmp_path / "c.tsv", "Kopf\thead\nNut\tgroove\nRad\twheel\tauto\nZug\ttrain\t\n")).collect())) == [("Nut", "groove", "custom"), ("Rad", "wheel", "auto"), ("Zug", "train", "")]
    g = write(tmp_path / "g.tsv", "# note\nNut\tslot\n\nRad\twheel\nNut\tgroove\nleer\t\n")
    assert dict(map(tuple, R.glossary(spark, g).collect())) == {"Nut": "groove", "Rad": "wheel", "leer": ""}
    low = R.glossary(spark, g, lower=True, needs_both=True)
    assert dict(map(tuple, low.collect())) == {"nut": "groove", "rad": "wheel"}
    h = R.headed_glossary(spark, write(tmp_path / "h.tsv", "n\tGerman\tCorrect EN\n1\tNut\tGroove\n2\tWelle\tShaft\n"))
    assert dict(map(tuple, R.merged_glossary(low, h).collect())) == {"nut": "groove", "rad": "wheel", "welle": "Shaft"}
    with pytest.raises(ValueError):
        R.sniffed_terms(spark, write(tmp_path / "bad.csv", "a,b\n1,2\n"))


def test_patents(spark, tmp_path):
    p = write(tmp_path / "p.csv", 'publication_number,ipc_code,claims_de\n1,A61F 2/24,"a ""b""\nc"\n2,A61F 1,\n3,B60,x\n')
    assert [r.publication_number for r in R.patents(spark, p, "A61F", ("claims_de",)).collect()] == ["1"]


def test_json(spark, tmp_path):
    log = write(tmp_path / "f.jsonl", '{"patent": "p", "segment_id": 1, "source": "user_feedback"}\nnot json\n\n{"patent": "q", "segment_id": 2}\n')
    rows = R.feedback_log(spark, log)
    assert sorted(r.segment_id for r in rows.collect()) == [1, 2]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        R.feedback_log(spark, log, strict=True).collect()
    assert R.all_feedback(rows, rows).count() == 3
    (tmp_path / "props").mkdir()
    write(tmp_path / "props/b.json", json.dumps({"rule_name": "r2", "_metadata": {"status": "approved"}}))
    write(tmp_path / "props/a.json", json.dumps({"rule_name": "r1", "_metadata": {"status": "pending"}}))
    write(tmp_path / "props/c.json", "{broken")
    assert [r.rule_name for r in R.proposals(spark, str(tmp_path / "props")).collect()] == ["r1", "r2"]
    assert [r.rule_name for r in R.proposals(spark, str(tmp_path / "props"), "approved").collect()] == ["r2"]
    d = write(tmp_path / "d.json", json.dumps({"segments": [{"index": 0, "t": "a"}, {"index": 1, "t": "b"}]}))
    assert R.json_document(spark, d, "segments").count() == 2


def test_sqlite(spark, tmp_path):
    c = sqlite3.connect(tmp_path / "x.db")
    c.execute("CREATE TABLE t (id INTEGER, split TEXT)")
    c.executemany("INSERT INTO t VALUES (?, ?)", [(1, "train"), (2, "test")])
    c.commit()
    c.close()
    assert [tuple(r) for r in R.sqlite_table(spark, str(tmp_path / "x.db"), "SELECT id, split FROM t WHERE split = 'test'", "id long, split string").collect()] == [(2, "test")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}\nx", "green", f"s{i}") for i in range(20)], "index long, translation string, triage string, source string").repartition(3)
    W.tsv(df.select("index", "triage"), str(tmp_path / "t"), ["index"])
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 20
    W.id_and_text(df, "index", "translation", str(tmp_path / "two"))
    assert spark.read.text(str(tmp_path / "two/texts")).count() == 20
    W.json_lines(df, str(tmp_path / "j"))
    W.json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 40
    assert W.report(df).filter("index = 3").orderBy("k").head().line == "[3] GREEN"


def test_catalog(spark):
    spark.range(3).createOrReplaceTempView("some_ids")
    assert ("some_ids", [("id", "bigint")]) in R.catalog(spark)
    spark.catalog.dropTempView("some_ids")


def test_sentences_of_documents(spark):
    rows = spark.createDataFrame([("a", 1, "zwei drei. Vier fünf sechs. [0001] Sieben acht neun."), ("a", 0, "Ein langer Satz ohne Ende"), ("b", 0, "kurz")], "doc_name string, idx int, text string")
    assert [tuple(r) for r in R.joined_sentences(rows).orderBy("doc_name", "idx").collect()] == [("a", 0, "Ein langer Satz ohne Ende zwei drei."), ("a", 1, "Vier fünf sechs. [0001] Sieben acht neun.")]
    assert [tuple(r) for r in R.sentences_by_paragraph(rows).orderBy("doc_name", "paragraph", "idx").collect()] == [("a", 0, 0, "Ein langer Satz ohne Ende"), ("a", 1, 0, "Vier fünf sechs."), ("a", 1, 1, "[0001] Sieben acht neun.")]


def test_pasted_glossary(spark):
    got = R.pasted_glossary(spark, "\n# Nut\tslot\nNut\tgroove\nkaputt\n Rad \t wheel \tx\nNut\tkeyway\n")
    assert dict(map(tuple, got.collect())) == {"# Nut": "slot", "Nut": "keyway", "Rad": "wheel"}
    assert R.pasted_glossary(spark, "").count() == 0


def test_first_feedback(spark, tmp_path):
    lines = [{"patent": "p", "segment_id": i % 7, "notes": str(i)} for i in range(20)] + [{"notes": "none"}, {"notes": "again"}]
    text = "\n".join(["{bad", *map(json.dumps, lines[:9]), "", "[1, 2", *map(json.dumps, lines[9:])])
    p = write(tmp_path / "log.jsonl", text + "\n")
    assert [r.notes for r in R.first_feedback(spark, p).collect()] == [*map(str, range(7)), "none"]
    assert [r.notes for r in R.first_feedback(spark, p, 3).collect()] == ["0", "1", "2"]


def test_tracker(spark, tmp_path):
    folder = str(tmp_path / "runs")
    W.track(spark.createDataFrame([("a", 30.456, 33.0)], "name string, bleu_baseline double, bleu_ape double"), folder)
    W.track(spark.createDataFrame([("b", 0.0, 20.0, "first, with a comma"), ("c", None, 1.5, None)], "name string, bleu_baseline double, bleu_ape double, notes string"), folder)
    rows = {r.name: r for r in R.records(spark, folder, ",").collect()}
    assert rows["a"].bleu_delta == "2.54" and rows["b"].bleu_delta is None and rows["b"].notes == "first, with a comma" and rows["c"].bleu_ape == "1.5"
    assert tuple(R.records(spark, folder, ",").columns) == W.TRACKER
    sheet = R.records(spark, write(tmp_path / "sheet.tsv", "ID\tPreferred\tNotes\n1\tA\tx, y\n2\t\tz\n"))
    assert [tuple(r) for r in sheet.orderBy("ID").collect()] == [("1", "A", "x, y"), ("2", None, "z")]
