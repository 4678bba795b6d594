"""Vector search: cosine top-k of query vectors against all vectors, in blocks."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of both sides; the vectors that travel are quadratic in the input over these sizes.
QUERY_BLOCK = 16_384
VECTOR_BLOCK = 16_384


def usable(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Rows whose vector has the given number of finite numbers, not all zero."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.size("vector") == dimensions).where(finite & F.exists("vector", lambda x: x != 0))


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows / np.sqrt((rows**2).sum(axis=1))[:, None]


def _best_of_block(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": left.column("query_id").slice(0, 0), "unit_seq": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        ids = right.column("unit").to_numpy()
        asked, given = _unit_rows(left.column("asked")), _unit_rows(right.column("given"))
        out, short = [], given.astype(np.float32).T
        for at in range(0, len(asked), 512):
            rough = asked[at : at + 512].astype(np.float32) @ short
            # Some more than k survive the rough scores, so that rounding can't lose one.
            keep = min(k + 8, len(ids))
            top = np.argpartition(-rough, keep - 1, axis=1)[:, :keep]
            exact = np.einsum("id,ikd->ik", asked[at : at + 512], given[top])
            out.append((np.repeat(np.arange(at, at + len(top)), keep), ids[top].ravel(), exact.ravel()))
        at, unit, similarity = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": left.column("query_id").take(pa.array(at)), "unit_seq": unit, "similarity": similarity})

    return run


def search(vectors: DataFrame, queries: DataFrame, top_k: int = 10, dimensions: int = 96, types: DataFrame | None = None, unit_types: list[str] | None = None) -> DataFrame:
    """(query_id, rank, unit_seq, similarity): the top_k vectors by cosine of each query vector.

    vectors: unit_seq (unique), vector; queries: query_id, vector. Vectors that are not usable are left
    out on both sides; ties go to the smaller unit_seq. Blocks of queries meet blocks of vectors, so no
    task holds more than one of each, and only each block's best leave it. With unit_types, only vectors of
    units of these types are searched; types: unit_seq, unit_type.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    if unit_types is not None:
        allowed = types.where(F.col("unit_type").isin(unit_types)).select("unit_seq").distinct()
        vectors = vectors.join(allowed, "unit_seq", "left_semi")
    vectors = usable(vectors.select(F.col("unit_seq").alias("unit_seq"), F.col("vector").alias("vector")), dimensions)
    queries = usable(queries.select(F.col("query_id").alias("query_id"), F.col("vector").alias("vector")), dimensions)
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    size = vectors.count()
    blocks, groups = max(1, ceil(size / VECTOR_BLOCK), min(parallel, size // 1_024)), max(1, ceil(queries.count() / QUERY_BLOCK))
    left = queries.select("query_id", F.col("vector").alias("asked"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = vectors.select(F.col("unit_seq").alias("unit"), F.col("vector").alias("given"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("of"), F.pmod(F.xxhash64("unit_seq"), F.lit(blocks)).cast("int").alias("part"))
    kind = dict(queries.dtypes)["query_id"]
    found = left.groupBy("g", "block").cogroup(right.groupBy("of", "part")).applyInArrow(_best_of_block(top_k), f"query_id {kind}, unit_seq long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 8).desc(), "unit_seq")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
