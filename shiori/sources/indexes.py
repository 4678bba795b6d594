"""Lasting indexes: written with a manifest, read back only if manifest, tokenizer and contents agree."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import LexicalIndex
from ..session import move, release
from .sinks import _put

FORMAT = 1
# Names and versions of the tokenizers that an index must agree with.
TOKENIZERS = {"a": "script-run-ngrams/1", "b": "word-pairs/1"}


class IndexMismatch(ValueError):
    """An index that isn't what its manifest says, or was made by another format, tokenizer or model."""


def _facts(df: DataFrame, *columns: str) -> dict:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*(columns or df.columns))).alias("c")).first()
    return {"n_rows": row["n"], "checksum": row["c"] or 0}


def _manifest(spark: SparkSession, path: str) -> dict:
    rows = spark.read.option("wholetext", "true").text(f"{path}/manifest.json").collect()
    return json.loads(rows[0][0])


def _expect(found: dict, **wanted) -> None:
    for name, value in wanted.items():
        if found.get(name) != value:
            raise IndexMismatch(f"{name} is {found.get(name)!r}, expected {value!r}")


def write_lexical(index: LexicalIndex, path: str, source: str = "") -> None:
    """The parts of an index as parquet below path, and last its manifest: an index without one is unfinished.

    Terms are sorted over the files, so that a search for few terms reads few row groups. The tables that
    build() kept are moved or given back as they are written, so the index given is used up.
    """
    spark = index.forward.sparkSession
    parts = {"forward": index.forward, "documents": index.documents, "terms": index.terms.repartitionByRange("term").sortWithinPartitions("term")}
    facts = {}
    for name, df in parts.items():
        if not move(df, f"{path}/{name}"):
            df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")
        facts[name] = _facts(spark.read.parquet(f"{path}/{name}"))
        release(getattr(index, name))  # where it was only kept for this
    _put(spark, f"{path}/manifest.json", json.dumps({"kind": "lexical", "format": FORMAT, "tokenizer": TOKENIZERS[index.kind], "source": source, "n_documents": index.n_documents, "average_length": index.average_length, "parts": facts}, sort_keys=True).encode())


def read_lexical(spark: SparkSession, path: str, kind: str = "a", source: str | None = None, verify: bool = True) -> LexicalIndex:
    """The index below path. Fails with IndexMismatch if it was made by another format or tokenizer, from
    another source (where one is given), or if, with verify set, a part differs from its manifest."""
    found = _manifest(spark, path)
    _expect(found, kind="lexical", format=FORMAT, tokenizer=TOKENIZERS[kind], **({} if source is None else {"source": source}))
    parts = {name: spark.read.parquet(f"{path}/{name}") for name in ("forward", "documents", "terms")}
    for name, df in parts.items():
        df._shiori_table = f"{path}/{name}"
    if verify:
        for name, df in parts.items():
            _expect({name: _facts(df)}, **{name: found["parts"][name]})
    return LexicalIndex(parts["forward"], parts["terms"], parts["documents"], found["n_documents"], found["average_length"], kind)


def write_vectors(vectors: DataFrame, path: str, model: str, dimensions: int, source: str = "") -> None:
    """Vectors (unit_seq, search_unit_id, vector) with a manifest of model, dimensions, rows and checksum."""
    spark = vectors.sparkSession
    vectors.select("unit_seq", "search_unit_id", "vector").write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/vectors")
    written = spark.read.parquet(f"{path}/vectors")
    _put(spark, f"{path}/manifest.json", json.dumps({"kind": "vectors", "format": FORMAT, "model": model, "dimensions": dimensions, "source": source, "parts": {"vectors": _facts(written)}}, sort_keys=True).encode())


def read_vectors(spark: SparkSession, path: str, model: str, dimensions: int, source: str | None = None, verify: bool = True) -> DataFrame:
    """The vectors below path; IndexMismatch as in read_lexical, and for vectors of another size."""
    found = _manifest(spark, path)
    _expect(found, kind="vectors", format=FORMAT, model=model, dimensions=dimensions, **({} if source is None else {"source": source}))
    vectors = spark.read.parquet(f"{path}/vectors")
    if verify:
        _expect({"vectors": _facts(vectors)}, vectors=found["parts"]["vectors"])
        _expect({"vectors of another size": vectors.where(~F.coalesce(F.size("vector") == dimensions, F.lit(False))).count()}, **{"vectors of another size": 0})
    return vectors
