"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows on; at most HOT_KEYS of them, the largest, are treated so.
#: Every key outside that list holds less than 1/HOT_KEYS of the rows.
HOT_ROWS = 200_000
HOT_KEYS = 2_000


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The hot keys of df as a table of at most HOT_KEYS rows, or None where there are none.

    The counts are combined on the map side; only the bounded list reaches the driver.
    """
    counts = df.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in on])).groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    rows = counts.where(F.col("__n") >= hot_rows).orderBy(F.desc("__n")).limit(HOT_KEYS).drop("__n").collect()
    return df.sparkSession.createDataFrame(rows, df.select(*on).schema) if rows else None


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join left to right, which has each key once, without sending a hot key's rows to one task.

    how: inner, left, left_semi or left_anti. Rows of hot keys stay where they are and meet the at most
    HOT_KEYS matching rows of right as a broadcast; all other rows take the shuffled join. Null keys
    match nothing. Both inputs are read more than once, so they should be scans or written tables.
    """
    hot = hot_keys(left, on, hot_rows)
    if hot is None:
        return left.join(right, on, how)
    marks = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    marked = left.join(marks, on, "left")
    few = right.join(F.broadcast(hot), on, "left_semi")
    is_hot = marked.where(F.col("__hot")).drop("__hot").join(F.broadcast(few), on, how)
    rest = marked.where(F.col("__hot").isNull()).drop("__hot").join(right, on, how)
    return is_hot.unionByName(rest)
