"""Frequency of every distinct term (problem 3).

A global integer dictionary numbers the terms without gaps (terms that differ in case or width share a
number). Encoded postings are counted per unit, the counts are accumulated in arrays over blocks of
BLOCK identifiers, and the arrays of all tasks are summed by block. A common term thus costs one array
cell per task, however many postings it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from ..operators.joins import HOT_ROWS, hot_join
from ..session import cut
from ..sources.tables import table
from .lookalike import fold_width

BLOCK = 4_096
RARE_UNITS = 2
COMMON_SHARE = 0.15

_ARRAYS = "block long, places array<int>, occurrences array<long>, units array<long>"


@F.pandas_udf(StringType())
def folded(terms):
    """Terms without case and width; null stays null."""
    return terms.map(lambda t: None if t is None else fold_width(t).lower())


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """df, which has each value of the long column once, with numbers 0.. in the order of that column.

    Only the sizes of the written partitions reach the driver.
    """
    ordered = df.repartitionByRange(column).sortWithinPartitions(column)
    marked = cut(ordered.withColumn("__m", F.monotonically_increasing_id()))
    sizes = marked.groupBy(F.shiftright("__m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    before, offsets = 0, []
    for row in sizes:
        offsets += [F.lit(row["p"]), F.lit(before)]
        before += row["n"]
    if not offsets:
        return marked.withColumn(name, F.lit(0).cast("long")).drop("__m")
    base = F.element_at(F.create_map(*offsets), F.shiftright("__m", 33))
    return marked.withColumn(name, (base + F.col("__m").bitwiseAND((1 << 33) - 1)).cast("long")).drop("__m")


def dictionary(terms: DataFrame) -> DataFrame:
    """(term_id, canonical_id, number): canonical_id is the smallest term_id of the same term."""
    once = terms.where(F.col("term_id").isNotNull()).groupBy("term_id").agg(F.min("term").alias("term"))
    keyed = cut(once.select("term_id", F.coalesce(F.concat(F.lit("t"), folded("term")), F.concat(F.lit("n"), F.col("term_id").cast("string"))).alias("key")))
    first = keyed.groupBy("key").agg(F.min("term_id").alias("canonical_id"))
    numbers = dense_ids(first, "canonical_id", "number")
    return keyed.join(numbers, "key").select("term_id", "canonical_id", "number")


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (number, total) sorted by number, one per unit: a pair of count arrays per block."""
    current, total, present = None, None, None
    for batch in batches:
        number = batch.column(0).to_numpy(zero_copy_only=False)
        amount = batch.column(1).to_numpy(zero_copy_only=False)
        blocks = number // BLOCK
        for block in np.unique(blocks):
            if block != current:
                if current is not None:
                    yield _arrays(current, total, present)
                current, total, present = block, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            mine = blocks == block
            np.add.at(total, number[mine] % BLOCK, amount[mine])
            present += np.bincount(number[mine] % BLOCK, minlength=BLOCK)
    if current is not None:
        yield _arrays(current, total, present)


def _arrays(block: int, total: np.ndarray, present: np.ndarray) -> pa.RecordBatch:
    """A block's counts: whole arrays, or where most are 0 the places of the others and their counts."""
    at = np.flatnonzero(present).astype(np.int32)
    if len(at) > BLOCK // 2:
        at = at[:0]
    else:
        total, present = total[at], present[at]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (at, total, present)]
    return pa.RecordBatch.from_arrays([pa.array([int(block)], pa.int64()), *lists], names=["block", "places", "occurrences", "units"])


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays sorted by block: one row (number, occurrences, units) per number that occurs."""

    def rows(block: int, total: np.ndarray, present: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(present)
        return pa.RecordBatch.from_arrays([pa.array(at + block * BLOCK), pa.array(total[at]), pa.array(present[at])], names=["number", "occurrences", "units"])

    current, total, present = None, None, None
    for batch in batches:
        for k, block in enumerate(batch.column(0).to_pylist()):
            if block != current:
                if current is not None:
                    yield rows(current, total, present)
                current, total, present = block, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            places = batch.column(1)[k].values.to_numpy()
            at = places if len(places) else slice(None)
            total[at] += batch.column(2)[k].values.to_numpy()
            present[at] += batch.column(3)[k].values.to_numpy()
    if current is not None:
        yield rows(current, total, present)


def term_counts(terms: DataFrame, postings: DataFrame, units: DataFrame, rare_units: int = RARE_UNITS, common_share: float = COMMON_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(term_id, occurrences, n_units, n_total, is_rare, is_common) of every term, under its smallest id.

    terms: term_id, term; postings: term_id, doc_rowid, term_frequency; units: unit_seq. An occurrence is
    a posting with a frequency above 0 whose unit exists; n_total is the number of units with one. Defined
    results: a posting that is repeated counts once, of different frequencies the largest counts; postings
    without term_id, unit or frequency count nothing; postings of ids that terms lacks count for n_total
    only; terms without postings have 0; a null term is a term of its own; a term may be rare and common at once
    where n_total is small; without terms there are no rows.
    """
    names = cut(dictionary(terms))
    valid = postings.select("term_id", "doc_rowid", "term_frequency").where((F.col("term_frequency") > 0) & F.col("doc_rowid").isNotNull() & F.col("term_id").isNotNull())
    once = valid.groupBy("doc_rowid", "term_id").agg(F.max("term_frequency").alias("tf"))
    there = units.select(F.col("unit_seq").alias("doc_rowid")).where(F.col("doc_rowid").isNotNull()).distinct()
    present = cut(once.join(there, "doc_rowid", "left_semi"))
    n_total = present.select("doc_rowid").distinct().count()
    encoded = hot_join(present, names.select("term_id", "number"), ["term_id"], "inner", hot_rows)
    per_unit = encoded.groupBy("doc_rowid", "number").agg(F.sum("tf").alias("total")).select("number", "total")
    arrays = per_unit.sortWithinPartitions("number").mapInArrow(_block_counts, _ARRAYS)
    counts = arrays.repartition("block").sortWithinPartitions("block").mapInArrow(_sum_blocks, "number long, occurrences long, units long")
    listed = names.select("canonical_id", "number").distinct().join(counts, "number", "left")
    units_of = F.coalesce("units", F.lit(0))
    return listed.select(
        F.col("canonical_id").alias("term_id"),
        F.coalesce("occurrences", F.lit(0)).cast("long").alias("occurrences"),
        units_of.cast("long").alias("n_units"),
        F.lit(n_total).cast("long").alias("n_total"),
        (units_of <= rare_units).alias("is_rare"),
        ((units_of >= common_share * n_total) & (units_of > 0)).alias("is_common"),
    )


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts(table(spark, folder, "terms", "term_id", "term"), table(spark, folder, "postings"), table(spark, folder, "search_units", "unit_seq"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    marks = F.filter(F.array(F.when(F.col("is_rare"), "rare"), F.when(F.col("is_common"), "common")), lambda x: x.isNotNull())
    return p3_terms(spark, folder).select("term_id", F.explode(marks).alias("mark"))
