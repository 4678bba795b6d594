"""Scans of the record tables: column-pruned parquet reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of a folder of parquet tables, reduced to the given columns (nested ones as a.b)."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
