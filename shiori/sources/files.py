"""File scans: discovery, metadata, plain texts, tables, notebooks, images, questions and predictions."""

from __future__ import annotations

import csv
import io
import struct
import unicodedata
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import ship

OFFICE = ["docx", "xlsx", "pptx", "pdf"]
# Media types by extension, and the encodings tried in turn for tables.
MEDIA = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "pdf": "application/pdf",
    "csv": "text/csv",
    "txt": "text/plain",
    "md": "text/markdown",
    "json": "application/json",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
}
ENCODINGS = ["utf-8-sig", "cp932", "shift_jis"]
#: Caps of the table scan: a feature of this source, which shows a table's head.
MAX_ROWS, MAX_CELL = 60, 200


@F.pandas_udf(StringType())
def composed(paths):
    """Paths in composed form (NFC)."""
    return paths.map(lambda p: None if p is None else unicodedata.normalize("NFC", p))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def discover(spark: SparkSession, root: str, suffixes: list[str] | None = None, content: bool = False) -> DataFrame:
    """The files under root with one of the suffixes (any case), without lock files (~$), in the order of
    their relative paths: path, relative_path, file_name, extension, media_type, size_bytes, modified_at.

    With content set their bytes come along; without, no file is opened.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    relative = composed(F.regexp_replace(F.col("path"), F.lit(rf"^(file:)?/*\Q{base.lstrip('/')}\E"), F.lit("")))
    rows = files.withColumn("relative_path", relative).withColumn("file_name", F.element_at(F.split("relative_path", "/"), -1)).withColumn("extension", extension(F.col("relative_path")))
    rows = rows.where(F.col("extension").isin(suffixes or OFFICE) & ~F.col("file_name").startswith("~$"))
    media = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair]), F.col("extension")), F.lit("application/octet-stream"))
    columns = ["path", "relative_path", "file_name", "extension", media.alias("media_type"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")]
    return rows.select(*columns, *(["content"] if content else [])).orderBy("relative_path")


def texts(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """Whole text files as path, text."""
    files = discover(spark, root, suffixes or ["md", "txt", "py", "json", "toml"], True)
    return files.select(F.col("relative_path").alias("path"), F.decode("content", "UTF-8").alias("text"))


def decode(content: bytes) -> tuple[str, str]:
    """Text and encoding of a table file: the first of ENCODINGS that fits."""
    for name in ENCODINGS:
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace"), "unknown"


def tables(files: DataFrame, max_rows: int = MAX_ROWS, max_cell: int = MAX_CELL) -> DataFrame:
    """(path, encoding, n_rows, text): header and first rows of CSV and TSV files (path, extension, content).

    n_rows counts all rows below the header; cells are cut to max_cell characters and joined by bars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, kind, content in zip(*[batch.column(c).to_pylist() for c in ("path", "extension", "content")]):
                text, encoding = decode(content or b"")
                rows = list(csv.reader(io.StringIO(text), delimiter="\t" if kind == "tsv" else ","))
                shown = [" | ".join(c.strip()[:max_cell] for c in r) for r in rows[:max_rows]]
                out.append((path, encoding, max(0, len(rows) - 1), "\n".join(shown)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.string(), pa.string(), pa.int64(), pa.string()])], names=["path", "encoding", "n_rows", "text"])

    return files.select("path", "extension", "content").mapInArrow(run, "path string, encoding string, n_rows long, text string")


def notebook_cells(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, location, kind, source, output) of the cells of notebooks; a cell without id is cell-<number from 0>."""
    schema = "cells array<struct<id:string,cell_type:string,source:array<string>,outputs:array<struct<text:array<string>,data:struct<`text/plain`:array<string>>>>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(paths).select(F.input_file_name().alias("path"), F.posexplode("cells").alias("at", "cell"))
    printed = F.flatten(F.transform("cell.outputs", lambda o: F.coalesce(o["text"], o["data"]["text/plain"], F.array().cast("array<string>"))))
    return raw.select("path", F.coalesce("cell.id", F.concat(F.lit("cell-"), F.col("at").cast("string"))).alias("location"), F.col("cell.cell_type").alias("kind"), F.array_join("cell.source", "").alias("source"), F.coalesce(F.array_join(printed, ""), F.lit("")).alias("output"))


def notebook_sections(cells: DataFrame, max_source: int = 6_000, max_output: int = 3_000) -> DataFrame:
    """(path, location, text): source without embedded images, and output, both clipped; empty cells are left out."""
    from ..functions.text import clip, strip

    mark = " …(以下略)"
    bare = F.regexp_replace("source", r"data:image/[a-z+]+;base64,[A-Za-z0-9+/=]+", "[画像]")
    text = strip(F.concat_ws("\n", clip(bare, max_source, mark), F.nullif(clip(F.coalesce("output", F.lit("")), max_output, mark), F.lit(""))))
    return cells.select("path", "location", text.alias("text")).where(F.col("text") != "")


def image_size(content: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF or JPEG; None for anything else."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return struct.unpack("<HH", content[6:10])
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content) and content[at] == 0xFF:
            size = struct.unpack(">H", content[at + 2 : at + 4])[0]
            if 0xC0 <= content[at + 1] <= 0xCF and content[at + 1] not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                return width, height
            at += 2 + size
    return None


def images(files: DataFrame) -> DataFrame:
    """(path, width, height, sha256, text): a stand-in text for each image, since nothing reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [image_size(c or b"") or (None, None) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32()), batch.column(2)], names=["path", "width", "height", "sha256"])

    sized = files.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInArrow(run, "path string, width int, height int, sha256 string")
    shown = F.when(F.col("width").isNull(), "").otherwise(F.concat(F.lit(" "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")))
    return sized.withColumn("text", F.concat(F.lit("[画像ファイル"), shown, F.lit("] ※OCR/VLM未実施")))


def questions(spark: SparkSession, path: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """(index, question, answer) of a question file with header, in the order of the file, from start on, at most limit."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    if "answer" not in rows.columns:
        rows = rows.withColumn("answer", F.lit(None).cast("string"))
    # A file with breaks within its lines is read in one piece, whose rows are numbered as they come.
    rows = rows.select(F.col("index").cast("long").alias("index"), "question", "answer", F.monotonically_increasing_id().alias("at")).orderBy("at").offset(start).drop("at")
    return rows if limit is None else rows.limit(limit)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(position, index, answer) of a headerless file of two columns, or of a ZIP that holds only predictions.csv."""
    raw = spark.read.format("binaryFile").load(path).first()["content"]
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            if z.namelist() != ["predictions.csv"]:
                raise ValueError("the archive must hold predictions.csv and nothing else")
            raw = z.read("predictions.csv")
    rows = [r for r in csv.reader(io.StringIO(raw.decode("utf-8-sig"))) if r]
    if any(len(r) != 2 for r in rows):
        raise ValueError("predictions need two columns")
    return spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(rows)], "position long, index string, answer string")
