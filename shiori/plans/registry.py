"""The named queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import hierarchy, references
from . import catalogue, sql, sql_catalogue

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p4_found": references.p4_found,
        "p4_report": references.p4_report,
        "p6_found": hierarchy.p6_found,
        "p6_hierarchy": hierarchy.p6_hierarchy,
        "p6_descendants": hierarchy.p6_descendants,
    } | {q.__name__: q for q in catalogue.QUERIES}


def oracle_sql() -> dict[str, str]:
    return sql.SQL | sql_catalogue.SQL
