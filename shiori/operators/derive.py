"""Search units from evidence: paragraph chunks, table rows, slide and page texts, sliding chunks.

Everything follows the order of events in a document (seq, evidence_id). Which events belong together is
found by comparing each with the one before (operators.sequence), so a long document is no single task.
Only the packing of paragraphs is a fold, over one section at a time, streamed from a sorted partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import NO_SPACE, column_number, strip
from ..session import cut
from .joins import hot_join
from .sequence import previous, running_last

TARGET_CHARS = 1_200
# The names that enter the units' ids, and the words of their texts.
BUILDER, BUILDER_VERSION = "search-unit-builder", "0.2.0"
SECTION, SLIDE = "セクション: ", "コンテナ種別: スライド\n"
HEADER_METHOD = "first_non_empty_row_candidate"

ORDER = ["seq", "evidence_id"]


def _place() -> Column:
    return F.struct("seq", "evidence_id")


def display_value(raw_text: Column, raw_value: Column) -> Column:
    """The text shown for a content: its text, else its value, stripped; '' where there is neither."""
    return strip(F.coalesce(raw_text, raw_value, F.lit("")))


def events(evidence: DataFrame) -> DataFrame:
    """The evidence that units derive from, with its kind (p, t, c, s, g) and shown value.

    Text blocks count as shapes on slides, as page texts on pages and as paragraphs elsewhere. Records
    without document or seq have no place in an order and are left out.
    """
    kind = (
        F.when(F.col("evidence_type").isin("heading", "paragraph"), "p")
        .when(F.col("evidence_type") == "table", "t")
        .when(F.col("evidence_type") == "table_cell", "c")
        .when(F.col("evidence_type") == "shape", "s")
        .when(F.col("evidence_type") == "page", "g")
        .when(F.col("evidence_type") == "text_block", F.when(F.col("slide_number").isNotNull(), "s").when(F.col("page_number").isNotNull(), "g").otherwise("p"))
    )
    rows = evidence.withColumn("kind", kind).where(F.col("kind").isNotNull() & F.col("document_id").isNotNull() & F.col("seq").isNotNull())
    return rows.withColumn("value", display_value(F.col("raw_text"), F.col("raw_value")))


def _key(*parts: Column | str) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])


def cells(rows: DataFrame) -> DataFrame:
    """Cells with container, row and column: by their sheet and A1 reference, else by table, else by slide shape.

    Cells whose place can't be told have no container.
    """
    letters = F.regexp_extract("cell", r"^([A-Z]{1,3})([1-9]\d*)$", 1)
    in_sheet = F.col("cell").isNotNull() & F.col("sheet_name").isNotNull()
    in_table = F.col("table_index").isNotNull() & F.col("row_index").isNotNull()
    in_shape = F.col("shape_id").isNotNull() & F.col("row_index").isNotNull() & F.col("slide_number").isNotNull()
    column = F.coalesce(F.col("column_index"), F.lit(1))
    valid = letters != ""
    sheet = lambda x: F.when(in_sheet, F.when(valid, x))
    return rows.withColumns({
        "container": sheet(_key(F.lit("sheet"), "sheet_name")).when(in_table, _key(F.lit("table"), "slide_number", "shape_id", "table_index")).when(in_shape, _key(F.lit("slide_table"), "slide_number", "shape_id")),
        "row_no": sheet(F.regexp_extract("cell", r"(\d+)$", 1).cast("int")).when(in_table | in_shape, F.col("row_index")),
        "column_no": sheet(column_number(letters).cast("int")).when(in_table | in_shape, column),
        "label": sheet(letters).when(in_table | in_shape, column.cast("string")),
    })


def _locator(**fields: Column) -> Column:
    """A locator with its keys in order; keys that aren't given are null."""
    kinds = {"page_number": "int", "paragraph_end": "int", "paragraph_start": "int", "row_index": "int", "shape_id": "string", "sheet_name": "string", "slide_number": "int", "table_index": "int"}
    return F.struct(*[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def _context(**fields: Column) -> Column:
    """What surrounds a unit; keys that aren't given are null."""
    kinds = {"heading_text": "string", "container_kind": "string", "container_heading_text": "string", "container_heading_evidence_ids": "array<string>", "header_labels": "array<string>", "header_evidence_ids": "array<string>", "header_method": "string", "is_header_candidate": "boolean"}
    return F.struct(*[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def table_rows(rows: DataFrame) -> DataFrame:
    """One unit per run of cells of one row, labelled by its container's first populated row.

    rows: events(). Paragraphs, shapes and pages end a row, table events don't.
    """
    placed = cells(rows)
    flow = placed.where((F.col("kind") != "t") & ((F.col("kind") != "c") | F.col("container").isNotNull()))
    row_key = F.when(F.col("kind") == "c", _key("container", "row_no"))
    flow = flow.select("document_id", *ORDER, "kind", "value", "container", "row_no", "column_no", "label", "sheet_name", "table_index", "slide_number", "shape_id", row_key.alias("row_key"))
    flow = previous(flow, "document_id", ORDER, {"row_before": F.col("row_key")})
    starts = (F.col("kind") == "c") & ~F.col("row_key").eqNullSafe(F.col("row_before"))
    runs = running_last(flow, "document_id", ORDER, {"run": (starts, _place())}).where(F.col("kind") == "c")
    cell = F.struct("column_no", "seq", "evidence_id", "label", "value")
    each = runs.groupBy("document_id", "run", "container", "row_no").agg(F.array_sort(F.collect_list(cell)).alias("cells"), *[F.first(c, ignorenulls=True).alias(c) for c in ("sheet_name", "table_index", "slide_number", "shape_id")])
    populated = lambda c: F.filter(c, lambda x: x["value"] != "")
    each = cut(each.where(F.exists("cells", lambda x: x["value"] != "")))
    # What a container's first row says about the others is worked out once, below the join.
    heads = each.groupBy("document_id", "container").agg(F.min_by(F.struct("run", "cells"), F.col("run")).alias("head"))
    heads = heads.select("document_id", "container", F.col("head.run").alias("head_run"), populated(F.col("head.cells")).alias("named"))
    later = F.filter("named", lambda x, i: ~F.exists(F.slice("named", i + 2, F.size("named")), lambda y: y["column_no"] == x["column_no"]))  # the last cell of a column names it
    heads = heads.select("document_id", "container", "head_run", F.transform("named", lambda h: h["evidence_id"]).alias("head_ids"), F.map_from_entries(F.transform(later, lambda h: F.struct(h["column_no"], h["value"]))).alias("labels"))
    is_heading = F.col("evidence_type") == "heading"
    marks = rows.where((F.col("kind") == "t") | is_heading).select("document_id", *ORDER, "kind", "evidence_type", "value", "table_index", "slide_number", "shape_id")
    headings = running_last(marks, "document_id", ORDER, {"heading": (is_heading, F.struct("evidence_id", "value"))})
    table = F.when(F.col("table_index").isNotNull(), _key(F.lit("table"), "slide_number", "shape_id", "table_index")).when(F.col("slide_number").isNotNull() & F.col("shape_id").isNotNull(), _key(F.lit("slide_table"), "slide_number", "shape_id"))
    above = headings.where(F.col("kind") == "t").withColumn("container", table).where(F.col("container").isNotNull()).groupBy("document_id", "container").agg(F.max_by("heading", _place()).alias("heading"), F.lit("table").alias("container_kind"))
    context = cut(heads.join(above, ["document_id", "container"], "left"))
    full = hot_join(each, context, ["document_id", "container"])
    is_head = F.col("head_run") == F.col("run")
    of_column = lambda x: F.when(is_head, x["label"]).otherwise(F.coalesce(F.element_at("labels", x["column_no"]), x["label"]))
    filled = populated(F.col("cells"))
    lines = F.transform(filled, lambda x: F.concat(of_column(x), F.lit(": "), x["value"]))
    none = F.array().cast("array<string>")
    section = F.when(F.col("heading.value") != "", F.array(F.concat(F.lit(SECTION), F.col("heading.value")))).otherwise(none)
    ids = F.array_distinct(F.concat(F.when(F.col("heading.value") != "", F.array("heading.evidence_id")).otherwise(none), F.when(is_head, none).otherwise(F.col("head_ids")), F.transform(filled, lambda x: x["evidence_id"])))
    in_sheet = F.col("container").startswith("sheet\x1f")
    locator = _locator(
        row_index=F.col("row_no"),
        sheet_name=F.when(in_sheet, F.col("sheet_name")),
        table_index=F.when(F.col("container").startswith("table\x1f"), F.col("table_index")),
        slide_number=F.when(~in_sheet, F.col("slide_number")),
        shape_id=F.when(~in_sheet, F.col("shape_id")),
    )
    labels = F.when(~is_head, F.transform("cells", of_column))
    titled = F.col("heading.value") != ""
    about = _context(
        container_kind=F.col("container_kind"),
        container_heading_text=F.when(titled, F.col("heading.value")),
        container_heading_evidence_ids=F.when(titled, F.array("heading.evidence_id")),
        header_labels=labels,
        header_evidence_ids=F.when(~is_head, F.col("head_ids")),
        header_method=F.lit(HEADER_METHOD),
        is_header_candidate=is_head,
    )
    return full.select(
        "document_id",
        F.lit("table_row").alias("unit_type"),
        ids.alias("source_evidence_ids"),
        locator.alias("locator"),
        F.array_join(F.concat(section, lines), "\n").alias("search_text"),
        about.alias("context"),
        labels.alias("header_labels"),
        is_head.alias("is_header_candidate"),
        F.element_at("cells", -1)["seq"].alias("last_seq"),
    )


def _pack(target: int):
    """Rows (document_id, section, seq, evidence_id, size, heading_size), sorted: chunk number and whether the
    chunk begins with the section's heading again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, count, chunk, again = None, 0, 0, 0, False
        for batch in batches:
            chunks, agains = [], []
            for document, section, size, heading in zip(*[batch.column(c).to_pylist() for c in ("document_id", "section", "size", "heading_size")]):
                if (document, section) != now:
                    now, total, count, chunk, again = (document, section), 0, 0, 0, False
                if count and total + size + 2 * count > target:
                    chunk, again = chunk + 1, heading is not None
                    total, count = (heading, 1) if again else (0, 0)
                total, count = total + size, count + 1
                chunks.append(chunk)
                agains.append(again)
            yield pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("section"), batch.column("seq"), batch.column("evidence_id"), pa.array(chunks, pa.int32()), pa.array(agains, pa.bool_())], names=["document_id", "section", "seq", "evidence_id", "chunk", "again"])

    return run


def paragraph_chunks(rows: DataFrame, target_chars: int = TARGET_CHARS) -> DataFrame:
    """Paragraphs packed up to target_chars with their separators; a heading begins a chunk and is repeated
    where one overflows. Tables, cells and pages end a chunk. A longer paragraph is a chunk of its own."""
    if target_chars < 100:
        raise ValueError("target_chars must be at least 100")
    flow = rows.where(F.col("kind").isin("t", "c", "g") | (F.col("kind") == "p") & (F.col("value") != ""))
    is_heading = F.col("evidence_type") == "heading"
    flow = running_last(flow, "document_id", ORDER, {
        "heading": (is_heading, F.struct("evidence_id", "value", "paragraph_index")),
        "opened": (F.col("kind").isin("t", "c", "g") | is_heading, _place()),
    })
    section = F.coalesce(F.concat_ws("\x1f", F.col("opened.seq").cast("string"), F.col("opened.evidence_id")), F.lit(""))
    paragraphs = cut(flow.where(F.col("kind") == "p").select("document_id", section.alias("section"), "seq", "evidence_id", "value", "paragraph_index", "heading", F.length("value").alias("size"), F.length("heading.value").alias("heading_size")))
    ordered = paragraphs.select("document_id", "section", "seq", "evidence_id", "size", "heading_size").repartition("document_id", "section").sortWithinPartitions("document_id", "section", "seq", "evidence_id")
    packed = ordered.mapInArrow(_pack(target_chars), "document_id string, section string, seq long, evidence_id string, chunk int, again boolean")
    joined = paragraphs.join(packed, ["document_id", "section", "seq", "evidence_id"])
    item = F.struct("seq", "evidence_id", "value", "paragraph_index")
    each = joined.groupBy("document_id", "section", "chunk", "again").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max_by("heading", _place()).alias("heading"))
    head = F.struct(F.lit(None).cast("long").alias("seq"), F.col("heading.evidence_id").alias("evidence_id"), F.col("heading.value").alias("value"), F.col("heading.paragraph_index").alias("paragraph_index"))
    items = F.when(F.col("again"), F.concat(F.array(head), F.col("items"))).otherwise(F.col("items"))
    each = each.withColumn("items", items)
    index = F.transform("items", lambda x: x["paragraph_index"])
    return each.select(
        "document_id",
        F.lit("paragraph_chunk").alias("unit_type"),
        F.transform("items", lambda x: x["evidence_id"]).alias("source_evidence_ids"),
        _locator(paragraph_start=F.array_min(index), paragraph_end=F.array_max(index)).alias("locator"),
        strip(F.array_join(F.transform("items", lambda x: x["value"]), "\n\n")).alias("search_text"),
        _context(heading_text=F.nullif(F.col("heading.value"), F.lit(""))).alias("context"),
        F.element_at("items", -1)["seq"].alias("last_seq"),
    )


def _texts_of(rows: DataFrame, kind: str, number: str, unit_type: str, prefix: str, breaks: list[str]) -> DataFrame:
    """Runs of filled events of a kind with the same number, joined by blank lines."""
    mine = (F.col("kind") == kind) & (F.col("value") != "") & F.col(number).isNotNull()
    flow = previous(rows.where(mine | F.col("kind").isin(breaks)), "document_id", ORDER, {"before": F.struct(F.col("kind").alias("kind"), F.col(number).alias("number"))})
    starts = mine & (F.col("before").isNull() | (F.col("before.kind") != kind) | ~F.col("before.number").eqNullSafe(F.col(number)))
    runs = running_last(flow, "document_id", ORDER, {"run": (starts, _place())}).where(mine)
    each = runs.groupBy("document_id", "run", number).agg(F.array_sort(F.collect_list(F.struct("seq", "evidence_id", "value"))).alias("items"))
    body = strip(F.array_join(F.transform("items", lambda x: x["value"]), "\n\n"))
    return each.select("document_id", F.lit(unit_type).alias("unit_type"), F.transform("items", lambda x: x["evidence_id"]).alias("source_evidence_ids"), _locator(**{number: F.col(number)}).alias("locator"), F.concat(F.lit(prefix), body).alias("search_text"), _context().alias("context"), F.element_at("items", -1)["seq"].alias("last_seq"))


def slide_texts(rows: DataFrame) -> DataFrame:
    """The filled shapes of a slide as one text, headed by the kind of its container."""
    return _texts_of(rows, "s", "slide_number", "slide_text", SLIDE, ["g"])


def page_texts(rows: DataFrame) -> DataFrame:
    return _texts_of(rows, "g", "page_number", "page_text", "", [])


def search_units(evidence: DataFrame, target_chars: int = TARGET_CHARS) -> DataFrame:
    """All units of the evidence: ids, type, sources, locator, text with hash and length.

    search_unit_id is content-addressed, so the same evidence gives the same ids in every run.
    """
    rows = cut(events(evidence))  # each kind of unit reads it again
    columns = ["document_id", "unit_type", "source_evidence_ids", "locator", "search_text", "context", "last_seq"]
    parts = [paragraph_chunks(rows, target_chars), table_rows(rows), slide_texts(rows), page_texts(rows)]
    units = parts[0].select(columns)
    for part in parts[1:]:
        units = units.unionByName(part.select(columns))
    units = units.where(F.col("search_text") != "").withColumn("sha256", F.sha2("search_text", 256))
    unit_id = stable_id("su", document_id=F.col("document_id"), unit_type=F.col("unit_type"), source_evidence_ids=F.col("source_evidence_ids"), locator=F.col("locator"), text_sha256=F.col("sha256"), builder=F.lit(BUILDER), builder_version=F.lit(BUILDER_VERSION))
    return units.select(unit_id.alias("search_unit_id"), "document_id", "unit_type", "source_evidence_ids", "locator", "search_text", "context", "sha256", F.length("search_text").cast("long").alias("char_count"), "last_seq")


def sliding_chunks(sections: DataFrame, size: int = 1_400, overlap: int = 200) -> DataFrame:
    """Pieces of size characters, each starting size - overlap after the one before; blank pieces are dropped.

    sections: text and any other columns. Texts up to size are one piece.
    """
    step = size - overlap
    starts = F.when(F.length("text") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step)))
    cut = sections.where(F.length("text") > 0).select("*", F.posexplode(starts).alias("piece_no", "start"))
    pieces = cut.withColumn("piece", F.substring(F.col("text"), F.col("start") + 1, F.lit(size)))
    return pieces.where(F.col("piece").rlike(NO_SPACE)).drop("text")


def containment_edges(evidence: DataFrame, generator: str = "intermediate-extractor", version: str = "0.4.0") -> DataFrame:
    """(relation_id, from_type, from_id, to_id): the edge from its parent, or else its document, to each evidence."""
    edges = evidence.select(
        F.when(F.col("parent_evidence_id").isNotNull(), "evidence").otherwise("document").alias("from_type"),
        F.coalesce("parent_evidence_id", "document_id").alias("from_id"),
        F.col("evidence_id").alias("to_id"),
    ).where(F.col("from_id").isNotNull())
    ref = lambda kind, key: F.struct(key.alias("record_id"), kind.alias("record_type"))
    identity = {"class": F.lit("structural"), "from": ref(F.col("from_type"), F.col("from_id")), "generator": F.lit(generator), "generator_version": F.lit(version), "to": ref(F.lit("evidence"), F.col("to_id")), "type": F.lit("contains")}
    relation = stable_id("rel", **identity)
    return edges.select(relation.alias("relation_id"), "*")
