"""The record tables as each record's one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def units(spark: SparkSession, folder: str) -> DataFrame:
    """Search units: unit_seq, search_unit_id, document_id, unit_type, search_text, source_evidence_ids."""
    rows = table(spark, folder, "search_units").where(F.col("search_unit_id").isNotNull())
    return rows.select("unit_seq", "search_unit_id", "document_id", "unit_type", F.col("text.search_text").alias("search_text"), "source_evidence_ids").distinct()


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence in the columns the derivation of units needs."""
    rows = table(spark, folder, "evidence").where(F.col("evidence_id").isNotNull())
    place = ["page_number", "slide_number", "sheet_name", "cell", "paragraph_index", "table_index", "row_index", "column_index", "shape_id"]
    return rows.select("evidence_id", "document_id", "evidence_type", "seq", F.col("content.raw_text").alias("raw_text"), F.col("content.raw_value").alias("raw_value"), *[F.col(f"location.{p}").alias(p) for p in place]).distinct()
