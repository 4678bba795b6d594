"""Office files as evidence, read with the standard library: word, sheet and slide archives, and PDF text layers.

A file that can't be read gives one 'failed' row instead of an error, so that one bad file does not stop
a scan. Each file is one row of the input; its evidence leaves the parser as rows, never as one object.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"

FIELDS = ["evidence_type", "raw_text", "section", "sheet_name", "cell", "page_number", "slide_number", "paragraph_index", "table_index", "row_index", "column_index", "shape_id", "parent", "warning"]
SCHEMA = "path string, seq long, evidence_type string, raw_text string, section string, sheet_name string, cell string, page_number int, slide_number int, paragraph_index int, table_index int, row_index int, column_index int, shape_id string, parent long, warning string"


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element:
    return ET.fromstring(z.read(name))


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx(content: bytes) -> Iterator[dict]:
    """Paragraphs, headings and table cells in the order of the body; a table names the heading above it."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _xml(z, "word/document.xml").find(f"{_W}body")
    words = lambda e: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    paragraph = table = 0
    section = None
    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            text = words(block)
            if not text.strip():
                continue
            paragraph += 1
            style = block.find(f"{_W}pPr/{_W}pStyle")
            heading = style is not None and (style.get(f"{_W}val") or "").lower().startswith("heading")
            section = text if heading else section
            yield {"evidence_type": "heading" if heading else "paragraph", "raw_text": text, "section": section, "paragraph_index": paragraph}
        elif block.tag == f"{_W}tbl":
            table += 1
            yield {"evidence_type": "table", "section": section, "table_index": table, "key": ("t", table)}
            for r, row in enumerate(block.findall(f"{_W}tr"), 1):
                for c, cell in enumerate(row.findall(f"{_W}tc"), 1):
                    yield {"evidence_type": "table_cell", "raw_text": "\n".join(words(p) for p in cell.findall(f"{_W}p")), "section": section, "table_index": table, "row_index": r, "column_index": c, "up": ("t", table)}


def xlsx(content: bytes) -> Iterator[dict]:
    """Sheets in the workbook's order, each with its non-empty cells, formulas below their cells, and merged ranges."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in _xml(z, "xl/sharedStrings.xml").findall(f"{_S}si")]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {r.get("Id"): r.get("Target", "") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        for sheet in _xml(z, "xl/workbook.xml").iter(f"{_S}sheet"):
            title, target = sheet.get("name"), targets.get(sheet.get(f"{_R}id"), "")
            member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            yield {"evidence_type": "worksheet", "sheet_name": title, "key": ("s", title)}
            if member not in names:
                continue
            root = _xml(z, member)
            for cell in root.iter(f"{_S}c"):
                ref, kind = cell.get("r"), cell.get("t")
                value, inline, formula = cell.find(f"{_S}v"), cell.find(f"{_S}is"), cell.find(f"{_S}f")
                if inline is not None:
                    text = "".join(t.text or "" for t in inline.iter(f"{_S}t"))
                elif value is not None and value.text is not None:
                    text = shared[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(value.text, value.text) if kind == "b" else value.text
                else:
                    text = None
                if text is None and formula is None:
                    continue
                yield {"evidence_type": "table_cell", "raw_text": text, "sheet_name": title, "cell": ref, "up": ("s", title), "key": ("c", title, ref)}
                if formula is not None:
                    yield {"evidence_type": "formula", "raw_text": f"={formula.text or ''}", "sheet_name": title, "cell": ref, "up": ("c", title, ref)}
            for merged in root.iter(f"{_S}mergeCell"):
                yield {"evidence_type": "merged_range", "raw_text": merged.get("ref"), "sheet_name": title, "up": ("s", title)}
        for kind, pattern in (("pivot_table", r"xl/pivotTables/pivotTable(\d+)\.xml"), ("chart", r"xl/charts/chart(\d+)\.xml")):
            for member in _numbered(names, pattern):
                yield {"evidence_type": kind, "raw_text": member}


def pptx(content: bytes) -> Iterator[dict]:
    """Slides in order, their shapes with text, and table cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        for number, member in enumerate(_numbered(names, r"ppt/slides/slide(\d+)\.xml"), 1):
            yield {"evidence_type": "slide", "slide_number": number, "key": ("s", number)}
            tree = _xml(z, member)
            for shape in tree.iter():
                if shape.tag not in (f"{_P}sp", f"{_P}graphicFrame"):
                    continue
                named = shape.find(f".//{_P}cNvPr")
                shape_id = named.get("id") if named is not None else None
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p"))
                if shape.tag == f"{_P}sp":
                    yield {"evidence_type": "shape", "raw_text": text, "slide_number": number, "shape_id": shape_id, "up": ("s", number)}
                    continue
                for table in shape.iter(f"{_A}tbl"):
                    key = ("t", number, shape_id)
                    yield {"evidence_type": "table", "slide_number": number, "shape_id": shape_id, "up": ("s", number), "key": key}
                    for r, row in enumerate(table.iter(f"{_A}tr"), 1):
                        for c, cell in enumerate(row.iter(f"{_A}tc"), 1):
                            yield {"evidence_type": "table_cell", "raw_text": "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in cell.iter(f"{_A}p")), "slide_number": number, "shape_id": shape_id, "row_index": r, "column_index": c, "up": key}


_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")


def _literal(raw: bytes) -> str:
    plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    text = _ESCAPE.sub(lambda m: plain.get(m[1]) or (b"" if m[1].endswith(b"\n") else m[1] if m[1] in b"()\\" else bytes([int(m[1], 8) & 255])), raw)
    return text[2:].decode("utf-16-be", "replace") if text[:2] == b"\xfe\xff" else text.decode("latin-1")


def pdf(content: bytes) -> Iterator[dict]:
    """One page evidence per page object, with the strings its content streams show; a page without any gets a warning.

    Only plain and deflated streams with simple encodings are read.
    """
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content, re.S)}
    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF")

    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\nendstream", body, re.S)
        if not m:
            return b""
        try:
            return zlib.decompress(m[1]) if b"FlateDecode" in body else m[1]
        except zlib.error:
            return b""

    pages = [body for _, body in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", body)]
    for number, body in enumerate(pages, 1):
        listed = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        parts = [stream(objects.get(int(n), b"")) for n in re.findall(rb"(\d+)\s+\d+\s+R", listed[1])] if listed else []
        lines = []
        for shown in re.finditer(rb"\[((?:[^\[\]\\]|\\.)*)\]\s*TJ|\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")", b"\n".join(parts), re.S):
            pieces = re.findall(rb"\(((?:[^()\\]|\\.)*)\)", shown[1]) if shown[1] is not None else [shown[2]]
            lines.append("".join(map(_literal, pieces)))
        text = "\n".join(lines).strip()
        yield {"evidence_type": "page", "raw_text": text or None, "page_number": number, "warning": None if text else "no text layer"}


PARSERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "pdf": pdf}


def parse(path: str, kind: str, content: bytes | None) -> list[dict]:
    """The rows of one file: seq from 1, parents by seq. Other kinds are deferred, broken files failed."""
    reader = PARSERS.get(kind)
    if reader is None:
        return [{"path": path, "seq": 1, "evidence_type": "metadata", "warning": "deferred: unsupported format"}]
    if kind != "pdf" and (content or b"")[:4] != b"PK\x03\x04":
        return [{"path": path, "seq": 1, "evidence_type": "metadata", "warning": "deferred: not an archive, probably encrypted"}]
    rows, keys = [], {}
    try:
        for seq, row in enumerate(reader(content or b""), 1):
            if key := row.pop("key", None):
                keys[key] = seq
            rows.append({"path": path, "seq": seq, "parent": keys.get(row.pop("up", None)), **row})
    except Exception as error:  # a broken file is a result, not a failure of the scan
        rows.append({"path": path, "seq": len(rows) + 1, "evidence_type": "metadata", "warning": f"failed: {type(error).__name__}"})
    return rows


def extract(files: DataFrame) -> DataFrame:
    """Evidence rows of files (relative_path, extension, content), in the columns of SCHEMA."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, content in zip(*[c.to_pylist() for c in batch.columns]):
                rows = parse(path, kind, content)
                for at in range(0, len(rows), 5_000):
                    part = rows[at : at + 5_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in part], schema.field(n).type) for n in names], schema=schema)

    return files.select("relative_path", "extension", "content").mapInArrow(run, SCHEMA)


def media(files: DataFrame) -> DataFrame:
    """(path, member, asset, content): the pictures inside office archives; asset is named by its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (content or b"")[:4] != b"PK\x03\x04":
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if "/media/" in name and not name.endswith("/"):
                            data = z.read(name)
                            asset = f"{hashlib.sha1(data).hexdigest()[:12]}.{name.rsplit('.', 1)[-1].lower()}"
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([asset]), pa.array([data], pa.binary())], names=["path", "member", "asset", "content"])

    return files.select("relative_path", "content").mapInArrow(run, "path string, member string, asset string, content binary")
