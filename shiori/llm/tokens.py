"""Token counts of texts by a public tokenizer's rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from hashlib import md5
from os.path import basename

import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .lookalike import visible_form

#: The rank file on the driver, which hands it to the executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(path: str = TOKENIZER) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_name(column: str = "source"):
    """One spelling of a source: trimmed, lower case, hyphens as underscores."""
    return F.replace(F.lower(F.trim(column)), F.lit("-"), F.lit("_"))


def with_sizes(documents: DataFrame, path: str = TOKENIZER, copies: bool = True) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of each document; the texts stay where they are scanned.

    copies names the group of texts of one visible form; it is left out if not wanted. Defined results:
    null and empty texts have 0 tokens; repeated rows of a doc_id count once, of different ones the
    longest; a null source stays null.
    """
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", source_name().alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    fields = [*rows.schema.fields[:2], StructField("n_tokens", IntegerType()), *[StructField("copies", StringType())] * copies]
    names = [f.name for f in fields]

    documents.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(basename(path))).encode_ordinary
        for batch in batches:
            texts = batch.column(2).to_pylist()
            columns = [batch.column(0), batch.column(1), pa.array([len(encode(t)) for t in texts], pa.int32())]
            if copies:
                columns.append(pa.array([md5(visible_form(t).encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    sized = rows.mapInArrow(run, StructType(fields))
    return sized.groupBy("doc_id").agg(F.max(F.struct("n_tokens", *[n for n in names if n not in ("doc_id", "n_tokens")])).alias("r")).select("doc_id", *[f"r.{n}" for n in names if n != "doc_id"])
