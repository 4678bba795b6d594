import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from shiori.sources import files, office, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def docx():
    para = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = para("章", "Heading1") + para("本文") + para(" ") + f"<w:tbl><w:tr>{cell('工程')}{cell('数')}</w:tr><w:tr>{cell('研磨')}{cell('3')}</w:tr></w:tbl>" + para("後")
    return archive(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/media/a.png": "PIC", "word/media/b.png": "PIC"})


def xlsx():
    sheet = '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>qty</t></is></c></row><row r="2"><c r="A2"><f>1+1</f><v>2</v></c><c r="B2"/></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells>'
    return archive(**{
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="台帳" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si></sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {S}>{sheet}</worksheet>",
        "xl/charts/chart1.xml": "<x/>",
    })


def pptx():
    text = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    slide = f'<p:sld {A}><p:sp><p:nvSpPr><p:cNvPr id="4"/></p:nvSpPr>{text("題")}</p:sp><p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="5"/></p:nvGraphicFramePr><a:tbl><a:tr><a:tc>{text("x")}</a:tc><a:tc>{text("y")}</a:tc></a:tr></a:tbl></p:graphicFrame></p:sld>'
    return archive(**{"ppt/slides/slide1.xml": slide, "ppt/slides/slide10.xml": slide.replace("題", "十"), "ppt/slides/slide2.xml": slide.replace("題", "二")})


def pdf():
    page = zlib.compress(b"BT (Hello \\(x\\)) Tj [(a) -20 (b)] TJ ET")
    return b"%PDF-1.4\n1 0 obj <</Type /Pages>> endobj\n2 0 obj <</Type /Page /Contents 3 0 R>> endobj\n3 0 obj <</Filter /FlateDecode>> stream\n" + page + b"\nendstream endobj\n4 0 obj <</Type /Page>> endobj"


@pytest.fixture()
def share(tmp_path):
    for name, data in {"a.docx": docx(), "Ｂ.XLSX": xlsx(), "c.pptx": pptx(), "d.pdf": pdf(), "~$a.docx": b"", "sub/e.docx": b"\xd0\xcf\x11\xe0 encrypted", "sub/f.docx": b"PK\x03\x04 broken", "g.txt": "text".encode()}.items():
        path = tmp_path / "share" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "share")


def test_discovery(spark, share):
    rows = files.discover(spark, share).collect()
    assert [r["relative_path"] for r in rows] == ["a.docx", "c.pptx", "d.pdf", "sub/e.docx", "sub/f.docx", "Ｂ.XLSX"]
    assert rows[0]["media_type"] == files.MEDIA["docx"] and rows[-1]["extension"] == "xlsx"
    assert [r["text"] for r in files.texts(spark, share).collect()] == ["text"]


def test_extraction(spark, share):
    got = {}
    for r in office.extract(files.discover(spark, share, content=True)).orderBy("path", "seq").collect():
        got.setdefault(r["path"], []).append(r)
    word = got["a.docx"]
    assert [(r["evidence_type"], r["raw_text"]) for r in word[:3]] == [("heading", "章"), ("paragraph", "本文"), ("table", None)]
    assert word[3]["raw_text"] == "工程" and word[3]["parent"] == 3 and word[3]["section"] == "章" and word[-1]["raw_text"] == "後"
    sheet = got["Ｂ.XLSX"]
    assert [(r["evidence_type"], r["cell"], r["raw_text"]) for r in sheet[1:]] == [("table_cell", "A1", "name"), ("table_cell", "B1", "qty"), ("table_cell", "A2", "2"), ("formula", "A2", "=1+1"), ("merged_range", None, "A1:B1"), ("chart", None, "xl/charts/chart1.xml")]
    assert sheet[4]["parent"] == sheet[3]["seq"]
    assert [r["raw_text"] for r in got["c.pptx"] if r["evidence_type"] == "shape"] == ["題", "二", "十"]
    assert [(r["row_index"], r["column_index"], r["raw_text"]) for r in got["c.pptx"] if r["evidence_type"] == "table_cell"][:2] == [(1, 1, "x"), (1, 2, "y")]
    assert [(r["page_number"], r["raw_text"], r["warning"]) for r in got["d.pdf"]] == [(1, "Hello (x)\nab", None), (2, None, "no text layer")]
    assert "encrypted" in got["sub/e.docx"][0]["warning"] and got["sub/f.docx"][-1]["warning"].startswith("failed")


def test_media(spark, share):
    rows = office.media(files.discover(spark, share, ["docx"], content=True).where("relative_path = 'a.docx'")).collect()
    assert len(rows) == 2 and len({r["asset"] for r in rows}) == 1


def test_tables_in_several_encodings(spark):
    rows = [("a.csv", "csv", "名,数\n台座,3\n".encode("cp932")), ("b.tsv", "tsv", "a\tb\n1\t2\n3\t4\n".encode("utf-8-sig")), ("c.csv", "csv", b""), ("d.csv", "csv", None)]
    got = {r["path"]: r for r in files.tables(spark.createDataFrame(rows, "path string, extension string, content binary")).collect()}
    assert got["a.csv"]["text"] == "名 | 数\n台座 | 3" and got["a.csv"]["encoding"] == "cp932"
    assert got["b.tsv"]["n_rows"] == 2 and got["c.csv"]["n_rows"] == 0 and got["d.csv"]["text"] == ""


def test_notebooks(spark, tmp_path):
    book = {"cells": [{"id": "x1", "cell_type": "code", "source": ["a = 1\n", "print(a)"], "outputs": [{"text": ["1\n"]}]}, {"cell_type": "markdown", "source": ["# t"]}]}
    (tmp_path / "n.ipynb").write_text(json.dumps(book))
    cells = files.notebook_cells(spark, str(tmp_path / "n.ipynb"))
    assert [(r["location"], r["source"], r["output"]) for r in cells.collect()] == [("x1", "a = 1\nprint(a)", "1\n"), ("cell-1", "# t", "")]
    assert [r["text"] for r in files.notebook_sections(cells).collect()] == ["a = 1\nprint(a)\n1", "# t"]


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (2).to_bytes(4, "big")
    rows = files.images(spark.createDataFrame([("a.png", png), ("b.png", b"no"), ("c.png", None)], "path string, content binary")).orderBy("path").collect()
    assert [r["text"] for r in rows] == ["[画像ファイル 3x2] ※OCR/VLM未実施", "[画像ファイル] ※OCR/VLM未実施", "[画像ファイル] ※OCR/VLM未実施"]


def test_questions_and_predictions(spark, tmp_path):
    (tmp_path / "q.csv").write_text("﻿index,question\n1,a\n2,\"b\nc\"\n3,d\n", encoding="utf-8")
    got = files.questions(spark, str(tmp_path / "q.csv"), start=1, limit=1).collect()
    assert [(r["index"], r["question"], r["answer"]) for r in got] == [(2, "b\nc", None)]
    df = spark.createDataFrame([(1, "2", "y\nz"), (0, "1", "x,1")], "position int, index string, answer string")
    for name, packed in (("p.csv", False), ("p.zip", True)):
        sinks.write_predictions(df, str(tmp_path / name), packed)
        assert [(r["index"], r["answer"]) for r in files.predictions(spark, str(tmp_path / name)).orderBy("position").collect()] == [("1", "x,1"), ("2", "y z")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d1", "e1"), ("d1", "e2"), ("d2", "e3")], "document_id string, evidence_id string")
    sinks.write_records(df, str(tmp_path / "r"))
    with pytest.raises(Exception):
        sinks.write_records(df, str(tmp_path / "r"))
    sinks.write_manifest(df, str(tmp_path / "m"), builder="x")
    manifest = spark.read.json(str(tmp_path / "m"))
    assert sinks.matches_manifest(df.repartition(3), manifest) and not sinks.matches_manifest(df.limit(2), manifest)
    sinks.write_sorted(df, str(tmp_path / "s"), ["evidence_id"])
    assert spark.read.json(str(tmp_path / "s")).count() == 3
    coverage = spark.createDataFrame([("b", "partial", None), ("a", "failed", "x"), ("c", "odd", None), ("a2", "extracted", None)], "path string, status string, detail string")
    assert [r["path"] for r in sinks.coverage_ledger(coverage).collect()] == ["a", "b", "a2", "c"]
    sinks.write_coverage(coverage, str(tmp_path / "c.md"))
    assert "- failed: 1" in (tmp_path / "c.md").read_text()
    for k in range(2):
        sinks.append_run_log(spark, str(tmp_path / "log"), run=k)
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_index(df.select(F.col("evidence_id").alias("term"), F.lit(1).alias("unit_seq")), df.select(F.col("evidence_id").alias("term")), df, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i/postings")).count() == 3
    sinks.report(spark.createDataFrame([(1, "ok", "a", None)], "query_id int, category string, expected string, predicted string"), str(tmp_path / "d.md"))
    assert "## 1: ok" in (tmp_path / "d.md").read_text()


def test_document_records(spark, share):
    from shiori.operators import documents

    listing = files.discover(spark, share, content=True)
    rows = {r["source"]["relative_path"]: r for r in documents.records(listing, office.extract(listing)).collect()}
    status = {k: r["extraction"]["status"] for k, r in rows.items()}
    assert status == {"a.docx": "success", "c.pptx": "success", "d.pdf": "partial", "sub/e.docx": "deferred", "sub/f.docx": "failed", "Ｂ.XLSX": "success"}
    assert rows["a.docx"]["document_id"].startswith("doc_") and rows["a.docx"]["n_evidence"] == 8
    wanted = spark.createDataFrame([("a.docx",), ("a.docx",), ("../x.docx",), ("nix.docx",)], "relative_path string")
    got = {(r["relative_path"], r["check"]) for r in documents.validate_inputs(listing, wanted).collect()}
    assert got == {("a.docx", "repeated"), ("../x.docx", "outside the root"), ("../x.docx", "missing"), ("nix.docx", "missing")}
