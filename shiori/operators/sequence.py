"""Ordered operators over long groups: values of the row before, and of the last marked row.

A window over a whole group would send a document that holds a third of all rows to one task. Here a
group is cut into chunks of its first order column; windows run within chunks, and what must cross a
chunk's border is one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 100_000


def running_last(df: DataFrame, key: str, order: list[str], marks: dict[str, tuple[Column, Column]], before: bool = False, chunk: int = CHUNK) -> DataFrame:
    """df with a column per mark: the value at the last row, in order, at which the condition held.

    marks: name -> (condition, value). The row itself counts, unless before is set. The first order column
    is a whole number; all together are unique within the key. Rows without key or order get nulls.
    """
    place = F.struct(*[F.col(c) for c in order])
    rows = df.withColumn("__chunk", F.floor(F.col(order[0]) / chunk))
    names = list(marks)
    for k, (condition, value) in enumerate(marks.values()):
        rows = rows.withColumn(f"__v{k}", F.when(condition, F.struct(place.alias("o"), value.alias("v"))))
    # Within a chunk the last marked row is the largest of those met so far, since it starts with its order.
    ends = rows.where(F.col("__chunk").isNotNull()).groupBy(key, "__chunk").agg(*[F.max_by(F.col(f"__v{k}")["v"], F.col(f"__v{k}")["o"]).alias(f"__e{k}") for k in range(len(names))], *[F.max(F.col(f"__v{k}")["o"]).alias(f"__o{k}") for k in range(len(names))])
    earlier = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    held = [F.last(F.when(F.col(f"__o{k}").isNotNull(), F.struct(F.col(f"__e{k}").alias("v"))), ignorenulls=True).over(earlier).alias(f"__c{k}") for k in range(len(names))]
    carried = ends.select(key, "__chunk", *held)
    inside = Window.partitionBy(key, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    joined = rows.join(carried, [key, "__chunk"], "left")
    for k, name in enumerate(names):
        here = F.last(F.when(F.col(f"__v{k}").isNotNull(), F.struct(F.col(f"__v{k}")["v"].alias("v"))), ignorenulls=True).over(inside)
        joined = joined.withColumn(name, F.coalesce(here, F.col(f"__c{k}"))["v"])
    return joined.drop("__chunk", *[f"__{p}{k}" for p in "vc" for k in range(len(names))])


def previous(df: DataFrame, key: str, order: list[str], values: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """df with values of the row before, in order: name of the new column -> value."""
    return running_last(df, key, order, {name: (F.lit(True), value) for name, value in values.items()}, True, chunk)
