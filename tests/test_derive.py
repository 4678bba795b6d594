from pyspark.sql import functions as F

from shiori.operators import derive

FIELDS = ["evidence_id", "document_id", "evidence_type", "seq", "raw_text", "raw_value", "page_number", "slide_number", "sheet_name", "cell", "paragraph_index", "table_index", "row_index", "column_index", "shape_id"]
SCHEMA = "evidence_id string, document_id string, evidence_type string, seq long, raw_text string, raw_value string, page_number int, slide_number int, sheet_name string, cell string, paragraph_index int, table_index int, row_index int, column_index int, shape_id string"


def evidence(spark, *rows):
    full = []
    for k, row in enumerate(rows, 1):
        full.append(tuple({"evidence_id": f"e{k:02d}", "document_id": "d", "seq": k, **row}.get(f) for f in FIELDS))
    return derive.events(spark.createDataFrame(full, SCHEMA))


def p(text, kind="paragraph", **more):
    return {"evidence_type": kind, "raw_text": text, **more}


def packed(spark, *rows):
    units = derive.paragraph_chunks(evidence(spark, *rows), 100).orderBy("last_seq", "search_text").collect()
    return [u["source_evidence_ids"] for u in units]


def test_packing(spark):
    assert packed(spark, p("a" * 60), p("b" * 38)) == [["e01", "e02"]]
    assert packed(spark, p("a" * 60), p("b" * 38), p("c")) == [["e01", "e02"], ["e03"]]
    assert packed(spark, p("H", "heading", paragraph_index=1), p("a" * 60), p("b" * 60)) == [["e01", "e02"], ["e01", "e03"]]
    assert packed(spark, p("H", "heading"), p("a" * 60), {"evidence_type": "table"}, p("b" * 60), p("c" * 60)) == [["e01", "e02"], ["e04"], ["e01", "e05"]]
    assert packed(spark, p(" "), p(None), p("x" * 500)) == [["e03"]]


def test_second_chunk_starts_at_the_heading(spark):
    units = derive.paragraph_chunks(evidence(spark, p("H", "heading", paragraph_index=1), p("a" * 60, paragraph_index=2), p("b" * 60, paragraph_index=3)), 100).orderBy("last_seq").collect()
    assert [(u["locator"]["paragraph_start"], u["locator"]["paragraph_end"], u["context"]["heading_text"]) for u in units] == [(1, 2, "H"), (1, 3, "H")]


def cell(ref, text, **more):
    return {"evidence_type": "table_cell", "sheet_name": "S", "cell": ref, "raw_text": text, **more}


def test_table_rows(spark):
    rows = evidence(spark, cell("A1", "name"), cell("B1", "qty"), cell("A2", "bolt"), cell("B2", ""), cell("A3", ""), cell("B3", None, raw_value="7"), cell("a9", "lost"), cell("A10", "nut"), p("text"), cell("B10", "9"))
    units = derive.table_rows(rows).orderBy("last_seq").collect()
    assert [u["search_text"] for u in units] == ["A: name\nB: qty", "name: bolt", "qty: 7", "name: nut", "qty: 9"]
    assert [u["is_header_candidate"] for u in units] == [True, False, False, False, False]
    assert units[1]["source_evidence_ids"] == ["e01", "e02", "e03"] and units[1]["header_labels"] == ["name", "qty"]
    assert units[2]["locator"]["row_index"] == 3 and units[2]["locator"]["sheet_name"] == "S"


def test_table_under_a_heading(spark):
    t = {"table_index": 1}
    rows = evidence(spark, p("品質", "heading"), {"evidence_type": "table", **t}, {"evidence_type": "table_cell", "raw_text": "工程", "row_index": 1, **t}, {"evidence_type": "table_cell", "raw_text": "研磨", "row_index": 2, **t})
    units = derive.table_rows(rows).orderBy("last_seq").collect()
    assert [u["search_text"] for u in units] == ["セクション: 品質\n1: 工程", "セクション: 品質\n工程: 研磨"]
    assert units[1]["source_evidence_ids"] == ["e01", "e03", "e04"]


def test_slides_and_pages(spark):
    s = lambda n, text: {"evidence_type": "shape", "slide_number": n, "raw_text": text}
    rows = evidence(spark, s(1, "a"), s(1, ""), s(1, "b"), s(2, "c"), s(1, "d"), {"evidence_type": "page", "page_number": 1, "raw_text": "page"}, s(1, "e"))
    assert [u["search_text"] for u in derive.slide_texts(rows).orderBy("last_seq").collect()] == [derive.SLIDE + x for x in ("a\n\nb", "c", "d", "e")]
    assert [(u["search_text"], u["locator"]["page_number"]) for u in derive.page_texts(rows).collect()] == [("page", 1)]


def test_unit_id(spark):
    row = ("ev_fb0236de4b6b5f18546f34f8a29b87d5", "doc_fff57077a3b481ef3135d9a2932f1dfa", "paragraph", 1, "hello", None, None, None, None, None, 1, None, None, None, None)
    units = derive.search_units(spark.createDataFrame([row, row], SCHEMA).distinct()).collect()
    assert [u["search_unit_id"] for u in units] == ["su_19b1ebddc42109865ccc09c62d13ab28"]


def test_empty_and_incomplete_evidence(spark):
    assert derive.search_units(spark.createDataFrame([], SCHEMA)).count() == 0
    assert evidence(spark, p("x", document_id=None), p("y", seq=None), p("z", "drawing")).count() == 0


def test_sliding_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 1400), (2, "x" * 1401), (3, "x" * 2700), (4, "  "), (5, ""), (6, None)], "id int, text string")
    got = {}
    for r in derive.sliding_chunks(df).orderBy("id", "start").select("id", "start", F.length("piece").alias("n")).collect():
        got.setdefault(r["id"], []).append((r["start"], r["n"]))
    assert got == {1: [(0, 1400)], 2: [(0, 1400), (1200, 201)], 3: [(0, 1400), (1200, 1400), (2400, 300)]}
