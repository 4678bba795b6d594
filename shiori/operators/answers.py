"""Answers: classification against expected ones, reports, and the check of a submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compatible, strip
from ..session import cut
from .containment import contains

# The categories of a diagnosis, and the abstention.
SUCCESS, GENERATION, RETRIEVAL, REVIEW = "成功", "回答生成不足", "検索不足", "要目視"
ABSTAIN = "わかりません"


def classify(expected: Column, predicted: Column, in_corpus: Column, in_top: Column) -> Column:
    """Category of an answer; expected and predicted in one normal form."""
    same = strip(F.coalesce(predicted, F.lit(""))) == strip(F.coalesce(expected, F.lit("")))
    return F.when(same, SUCCESS).when(F.coalesce(in_top, F.lit(False)), GENERATION).when(F.coalesce(in_corpus, F.lit(False)), RETRIEVAL).otherwise(REVIEW)


def diagnose(questions: DataFrame, predictions: DataFrame, chunks: DataFrame, hits: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Per question: whether the expected answer occurs in the corpus and among its hits, and the category.

    questions: query_id, expected; predictions: query_id, predicted; chunks: cid, text; hits: query_id,
    cid; reviews: query_id, final. Questions without prediction count as abstained; a review overrules.
    The corpus is searched by anchors (operators.containment), not question by question.
    """
    asked = questions.where(F.length("expected") > 0).select("query_id", "expected")
    # Chunks meet answers, not the questions that expect the same: these would be rows by chunks.
    where = cut(contains(chunks.select("cid", "text"), "cid", "text", asked.select("expected").distinct(), "expected"))
    corpus = asked.join(where.select("expected").distinct(), "expected", "left_semi").select("query_id").distinct().withColumn("in_corpus", F.lit(True))
    shown = asked.join(hits.select("query_id", "cid"), "query_id")
    top = shown.join(where, ["cid", "expected"], "left_semi").select("query_id").distinct().withColumn("in_top", F.lit(True))
    rows = questions.select("query_id", "expected").join(predictions.select("query_id", "predicted"), "query_id", "left").join(corpus, "query_id", "left").join(top, "query_id", "left")
    rows = rows.withColumn("predicted", F.coalesce("predicted", F.lit(ABSTAIN)))
    automatic = classify(compatible("expected"), compatible("predicted"), F.col("in_corpus"), F.col("in_top"))
    rows = rows.withColumn("automatic", automatic)
    if reviews is not None:
        rows = rows.join(reviews.select("query_id", F.nullif(strip(F.col("final")), F.lit("")).alias("reviewed")), "query_id", "left")
    else:
        rows = rows.withColumn("reviewed", F.lit(None).cast("string"))
    no = F.lit(False)
    return rows.select("query_id", "expected", "predicted", F.coalesce("in_corpus", no).alias("in_corpus"), F.coalesce("in_top", no).alias("in_top"), "automatic", F.coalesce("reviewed", "automatic").alias("category"))


def category_counts(diagnosed: DataFrame) -> DataFrame:
    """Questions per category, with the abstentions among them."""
    return diagnosed.groupBy("category").agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(F.col("predicted").startswith(ABSTAIN)).alias("n_abstained"))


def submission(expected: DataFrame, predictions: DataFrame, max_bytes: int = 1_000) -> DataFrame:
    """(position, check): where predictions (position, index, answer) differ from the expected order
    (position, index), are repeated, empty or too long (UTF-8 bytes bound the number of tokens)."""
    both = expected.select("position", F.col("index").alias("wanted")).join(predictions, "position", "full_outer")
    again = predictions.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("index"))).where(F.col("n") > 1)
    checks = {
        "order differs": both.where(~F.col("wanted").eqNullSafe(F.col("index"))),
        "index repeated": again,
        "answer empty": predictions.where(strip(F.coalesce("answer", F.lit(""))) == ""),
        "answer too long": predictions.where(F.octet_length("answer") > max_bytes),
    }
    out = None
    for name, bad in checks.items():
        rows = bad.select("position", F.lit(name).alias("check"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def longest(predictions: DataFrame) -> DataFrame:
    """The size of the longest answer in bytes and its index; of equal ones the smallest index."""
    return predictions.agg(F.max(F.octet_length("answer")).alias("most_bytes"), F.max_by("index", F.struct(F.octet_length("answer"), -F.col("index"))).alias("index"))
