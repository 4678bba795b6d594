import hashlib
import json

import pytest
from pyspark.sql import functions as F

from shiori.operators import quality


def stable(prefix, value):
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return f"{prefix}_{hashlib.sha256(text.encode()).hexdigest()[:32]}"


def digest(value):
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


DOC = stable("doc", {"relative_path": "a/b.docx", "source_sha256": "00"})
TEXT = {"raw_text": "台座 12"}
PLACE = {"page_number": 3, "sheet_name": "表"}
EV = stable("ev", {"document_id": DOC, "evidence_type": "paragraph", "location": PLACE, "content_sha256": digest(TEXT)})
REL = {"class": "structural", "type": "contains", "from": {"record_type": "document", "record_id": DOC}, "to": {"record_type": "evidence", "record_id": EV}, "generator": "g", "generator_version": "1"}
UNIT_TEXT = "台座 12"
UNIT = {"document_id": DOC, "unit_type": "paragraph_chunk", "source_evidence_ids": [EV], "locator": {"page_number": 3}, "text_sha256": hashlib.sha256(UNIT_TEXT.encode()).hexdigest(), "builder": "search-unit-builder", "builder_version": "1"}

DOC_SCHEMA = "schema_version string, record_type string, document_id string, source struct<relative_path string, sha256 string, size_bytes long>, extraction struct<status string>"
EV_SCHEMA = "schema_version string, record_type string, evidence_id string, document_id string, evidence_type string, location struct<sheet_name string, page_number int, cell string>, content struct<raw_text string, raw_value string, content_ref string, sha256 string>, parent_evidence_id string, provenance struct<extractor string>"
REL_SCHEMA = "relation_id string, relation_class string, relation_type string, from_ref struct<record_type string, record_id string>, to_ref struct<record_type string, record_id string>, supporting_evidence_ids array<string>, provenance struct<generated_by string, generator_version string>"
UNIT_SCHEMA = "search_unit_id string, document_id string, unit_type string, source_evidence_ids array<string>, locator struct<sheet_name string, page_number int>, text struct<search_text string, sha256 string, char_count long>, context struct<header_evidence_ids array<string>, container_heading_evidence_ids array<string>>, provenance struct<builder string, builder_version string, deterministic boolean>"
CASE_SCHEMA = "eval_case_id string, record_type string, query string, relevant_search_unit_ids array<string>, provenance struct<method string, generator string, generator_version string>, review struct<reviewed boolean, source_locations array<string>>"


def documents(spark, **change):
    row = {"schema_version": "0.1", "record_type": "document", "document_id": DOC, "source": ("a/b.docx", "00", 7), "extraction": ("success",)} | change
    return spark.createDataFrame([tuple(row.values())], DOC_SCHEMA)


def evidence(spark, **change):
    row = {"schema_version": "0.1", "record_type": "evidence", "evidence_id": EV, "document_id": DOC, "evidence_type": "paragraph", "location": ("表", 3, None), "content": ("台座 12", None, None, digest(TEXT)), "parent": None, "provenance": ("x",)} | change
    return spark.createDataFrame([tuple(row.values())], EV_SCHEMA)


def relations(spark, **change):
    row = {"relation_id": stable("rel", REL), "relation_class": "structural", "relation_type": "contains", "from_ref": ("document", DOC), "to_ref": ("evidence", EV), "support": [EV], "provenance": ("g", "1")} | change
    return spark.createDataFrame([tuple(row.values())], REL_SCHEMA)


def units(spark, **change):
    row = {"search_unit_id": stable("su", UNIT), "document_id": DOC, "unit_type": "paragraph_chunk", "sources": [EV], "locator": (None, 3), "text": (UNIT_TEXT, UNIT["text_sha256"], len(UNIT_TEXT)), "context": ([EV], []), "provenance": ("search-unit-builder", "1", True)} | change
    return spark.createDataFrame([tuple(row.values())], UNIT_SCHEMA)


def cases(spark, n=1, **change):
    made = {"query": "台座", "relevant_search_unit_ids": ["su_" + "a" * 32], "method": "human_reviewed", "generator": "g", "generator_version": "1"}
    row = {"eval_case_id": stable("qe", made), "record_type": "retrieval_eval_case", "query": "台座", "relevant": ["su_" + "a" * 32], "provenance": ("human_reviewed", "g", "1"), "review": (True, ["p1"])} | change
    return spark.createDataFrame([tuple(row.values())] * n, CASE_SCHEMA)


def found(df):
    return {r["check"] for r in df.collect()}


def test_true_records_have_no_violations(spark):
    nodes = spark.createDataFrame([("document", DOC), ("evidence", EV)], "record_type string, record_id string")
    assert found(quality.documents(documents(spark))) == set()
    assert found(quality.evidence(evidence(spark), documents(spark))) == set()
    assert found(quality.relations(relations(spark), nodes)) == set()
    assert found(quality.search_units(units(spark), documents(spark), evidence(spark))) == set()
    assert found(quality.eval_cases(cases(spark), spark.createDataFrame([("su_" + "a" * 32,)], "search_unit_id string"))) == set()


@pytest.mark.parametrize("change, check", [
    ({"record_type": "evidence"}, "schema version or record type wrong"), ({"source": None}, "required field missing"), ({"document_id": "doc_x"}, "document id malformed"),
    ({"extraction": ("odd",)}, "status unknown"), ({"source": ("a/c.docx", "00", 7)}, "document id unstable"),
])
def test_documents(spark, change, check):
    assert check in found(quality.documents(documents(spark, **change)))


@pytest.mark.parametrize("change, check", [
    ({"content": ("台座 13", None, None, digest(TEXT))}, "text hash wrong"), ({"content": (None, None, None, digest(TEXT))}, "content without payload"), ({"location": ("表", 4, None)}, "evidence id unstable"),
    ({"document_id": "doc_" + "0" * 32}, "document dangling"), ({"parent": "ev_" + "0" * 32}, "parent dangling"), ({"evidence_type": None}, "required field missing"), ({"schema_version": "0.2"}, "schema version or record type wrong"),
])
def test_evidence(spark, change, check):
    assert check in found(quality.evidence(evidence(spark, **change), documents(spark)))


def test_parents_of_other_documents_and_repeated_ids(spark):
    other = "doc_" + "1" * 32
    rows = evidence(spark).unionByName(evidence(spark, evidence_id="ev_" + "2" * 32, document_id=other, parent=EV)).unionByName(evidence(spark, evidence_id="ev_" + "2" * 32, document_id=other))
    assert {"parent in another document", "evidence id ambiguous"} <= found(quality.evidence(rows, documents(spark), recompute_ids=False))


@pytest.mark.parametrize("change, check", [
    ({"from_ref": ("page", DOC)}, "from_ref of another type"), ({"to_ref": ("evidence", "ev_0")}, "to_ref dangling"), ({"support": [EV, "ev_0"]}, "supporting evidence dangling"),
    ({"relation_type": "follows"}, "relation id unstable"), ({"relation_id": "rel_"}, "relation id malformed"),
])
def test_relations(spark, change, check):
    nodes = spark.createDataFrame([("document", DOC), ("evidence", EV)], "record_type string, record_id string")
    assert check in found(quality.relations(relations(spark, **change), nodes))


@pytest.mark.parametrize("change, check", [
    ({"sources": [EV, "ev_0"]}, "source dangling or of another document"), ({"sources": [EV, EV]}, "source repeated"), ({"document_id": "doc_0"}, "document dangling"), ({"locator": (None, 4)}, "unit id unstable"),
    ({"provenance": ("other", "1", True)}, "provenance wrong"), ({"context": (["ev_0"], [])}, "header not among sources"), ({"context": ([], ["ev_0"])}, "heading not among sources"), ({"text": ("", "", 0)}, "text empty"),
])
def test_units(spark, change, check):
    assert check in found(quality.search_units(units(spark, **change), documents(spark), evidence(spark)))


@pytest.mark.parametrize("change, check", [
    ({"query": "other"}, "case id unstable"), ({"relevant": []}, "relevance set empty or repeated"), ({"relevant": ["x"]}, "relevant id malformed"), ({"review": (True, [])}, "review lacks evidence"), ({"query": " "}, "query empty"),
    ({"record_type": "x"}, "record type wrong"), ({"n": 2}, "case id repeated"),
])
def test_eval_cases(spark, change, check):
    assert check in found(quality.eval_cases(cases(spark, **change)))
    assert "relevant unit not in the index" in found(quality.eval_cases(cases(spark), spark.createDataFrame([], "search_unit_id string")))


def test_source_files_are_hashed_again(spark):
    files = spark.createDataFrame([("a/b.docx", "00", 7)], "path string, sha256 string, size_bytes long")
    assert found(quality.source_files(documents(spark), files)) == set()
    assert found(quality.source_files(documents(spark, source=("../b.docx", "00", 7)), files)) == {"source path leaves the root"}
    assert found(quality.source_files(documents(spark, source=("a/x.docx", "00", 7)), files)) == {"source file missing"}
    assert found(quality.source_files(documents(spark), files.withColumn("sha256", F.lit("11")).withColumn("size_bytes", F.lit(8).cast("long")))) == {"source hash wrong", "source size wrong"}


def test_unexpected_fields_are_named(spark):
    df = units(spark)
    assert quality.unexpected_fields(df.schema, quality.UNIT_FIELDS) == []
    more = df.withColumn("score", F.lit(1)).withColumn("text", F.struct("text.*", F.lit("x").alias("lang")))
    assert quality.unexpected_fields(more.schema, quality.UNIT_FIELDS) == ["score", "text.lang"]
