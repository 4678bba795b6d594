"""Weighted reciprocal rank fusion of lexical and vector hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confidence(lexical: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, coverage, margin) of the lexical hits: coverage of the first hit, its lead over the second.

    Without hits both are null; with one hit the margin is null (no bound).
    """
    first, second = F.col("rank") == 1, F.col("rank") == 2
    score = F.round("score", 8)
    each = lexical.groupBy("query_id").agg(
        F.max(F.when(first, F.col("matched_terms") / F.greatest(F.col("n_terms"), F.lit(1)))).alias("coverage"),
        F.max(F.when(first, score)).alias("lead"),
        F.max(F.when(second, score)).alias("next"),
    )
    return queries.select("query_id").distinct().join(each, "query_id", "left").select("query_id", "coverage", (F.col("lead") / F.greatest(F.col("next"), F.lit(1e-12))).alias("margin"))


def hybrid(
    lexical: DataFrame,
    semantic: DataFrame,
    queries: DataFrame,
    top_k: int = 10,
    rrf_k: int = 60,
    lexical_weight: float = 1.0,
    semantic_weight: float = 0.25,
    adaptive: bool = True,
    low_coverage: float = 0.25,
    low_margin: float = 1.4,
    low_confidence_weight: float = 1.0,
) -> DataFrame:
    """The top_k units of each query by the sum of weight / (rrf_k + rank) over both lists.

    lexical: query_id, rank, score, matched_terms, n_terms, search_unit_id; semantic: query_id, rank,
    search_unit_id. With adaptive set, queries without confident lexical hits give the vectors at least
    low_confidence_weight. Ties go to the smaller search_unit_id.
    """
    if min(lexical_weight, semantic_weight, low_confidence_weight) < 0 or not 0 <= low_coverage <= 1 or low_margin <= 0 or top_k < 1:
        raise ValueError("weights and thresholds are out of range")
    unsure = F.col("coverage").isNull() | (F.col("coverage") < low_coverage) & (F.col("margin") < low_margin)
    weight = F.when(F.lit(adaptive) & F.coalesce(unsure, F.lit(False)), max(semantic_weight, low_confidence_weight)).otherwise(semantic_weight)
    weights = confidence(lexical, queries).select("query_id", weight.alias("semantic_weight"))
    lists = lexical.select("query_id", "search_unit_id", F.col("rank").alias("lexical_rank"), F.lit(None).cast("int").alias("semantic_rank")).unionByName(semantic.select("query_id", "search_unit_id", F.lit(None).cast("int").alias("lexical_rank"), F.col("rank").alias("semantic_rank")))
    merged = lists.groupBy("query_id", "search_unit_id").agg(F.min("lexical_rank").alias("lexical_rank"), F.min("semantic_rank").alias("semantic_rank")).join(weights, "query_id")
    part = lambda w, r: F.coalesce(w / (rrf_k + F.col(r)), F.lit(0.0))
    scored = merged.withColumn("score", part(F.lit(float(lexical_weight)), "lexical_rank") + part(F.col("semantic_weight"), "semantic_rank"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "search_unit_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "search_unit_id", F.round("score", 10).alias("score"), "lexical_rank", "semantic_rank", "semantic_weight")
