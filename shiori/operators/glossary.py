"""Glossary of aliases: building it from tables, finding aliases in texts, expanding questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_alternatives, strip
from .containment import contains

MIN_ASCII, MIN_OTHER = 2, 2
# What the heads of a glossary's columns contain.
ALIAS_HEADS = ["社内用語", "略称", "主略称", "略号"]
CANONICAL_HEADS = ["正式名称", "案件名", "正式"]
OTHER_HEADS = ["別名", "別名候補"]


def pairs_of_tables(tables: DataFrame) -> DataFrame:
    """(alias, canonical, ord) cells of the tables that are glossaries: their first row names a column of aliases
    and one of canonical names; a column of other names counts as aliases too.

    tables: table_id, row_no, cells (array of strings, first row the head). Rows too short for either column
    are passed over; tables of one row hold nothing.
    """

    def column(heads: list[str]):
        return F.array_position(F.transform("cells", lambda c: F.exists(F.array(*[F.lit(h) for h in heads]), lambda h: F.contains(F.coalesce(c, F.lit("")), h))), True)

    first = tables.groupBy("table_id").agg(F.min("row_no").alias("row_no"))
    heads = tables.join(first, ["table_id", "row_no"]).select("table_id", F.col("row_no").alias("head_no"), column(ALIAS_HEADS).alias("a"), column(CANONICAL_HEADS).alias("c"), column(OTHER_HEADS).alias("o"))
    rows = tables.join(heads.where((F.col("a") > 0) & (F.col("c") > 0)), "table_id").where(F.col("row_no") > F.col("head_no"))
    rows = rows.where(F.size("cells") >= F.greatest("a", "c"))
    cell = lambda at: F.get("cells", F.col(at).cast("int") - 1)
    other = F.when(F.col("o") > 0, cell("o"))
    each = rows.select("table_id", "row_no", cell("c").alias("canonical"), F.posexplode(F.array(cell("a"), other)).alias("k", "alias")).where(F.col("alias").isNotNull())
    return each.select("alias", "canonical", F.concat_ws("/", "table_id", F.lpad(F.col("row_no").cast("string"), 9, "0"), F.col("k").cast("string")).alias("ord"))


def build(pairs: DataFrame) -> DataFrame:
    """(alias, canonical, ord) of alias cells and canonical cells (alias, canonical, ord).

    A cell may hold several alternatives. Short aliases and those equal to their canonical name are
    dropped; of repeated pairs the first counts.
    """
    each = pairs.select(F.explode(split_alternatives(F.col("alias"))).alias("alias"), strip(F.col("canonical")).alias("canonical"), "ord")
    ascii_only = ~F.col("alias").rlike(r"[^\x00-\x7F]")
    kept = each.where((F.col("canonical") != "") & (F.col("alias") != F.col("canonical")) & (F.length("alias") >= F.when(ascii_only, MIN_ASCII).otherwise(MIN_OTHER)))
    return kept.groupBy("alias", "canonical").agg(F.min("ord").alias("ord"))


def lookup(questions: DataFrame, glossary: DataFrame) -> DataFrame:
    """(query_id, alias, canonical, ord): the aliases that occur in each question (query_id, query)."""
    return contains(questions.select("query_id", "query"), "query_id", "query", glossary, "alias", words=True).drop("query")


def expand(questions: DataFrame, glossary: DataFrame, heading: str = "[社内用語の展開]") -> DataFrame:
    """(query_id, query, expanded, names): the question with its aliases explained, longest first, and the
    distinct canonical names in that order."""
    found = lookup(questions, glossary)
    first = F.min("ord").over(Window.partitionBy("query_id", "alias"))
    by_alias = found.withColumn("first", first).groupBy("query_id", "alias").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "canonical"))).alias("names"))
    item = F.struct((-F.length("alias")).alias("less"), "first", "alias", F.transform("names", lambda x: x["canonical"]).alias("names"))
    lists = by_alias.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("hits"))
    lines = F.transform("hits", lambda h: F.concat(F.lit("- "), h["alias"], F.lit(" = "), F.array_join(h["names"], " / ")))
    none = F.array().cast("array<string>")
    joined = questions.select("query_id", "query").join(lists, "query_id", "left")
    return joined.select("query_id", "query", F.when(F.col("hits").isNull(), F.col("query")).otherwise(F.concat("query", F.lit(f"\n\n{heading}\n"), F.array_join(lines, "\n"))).alias("expanded"), F.coalesce(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["names"]))), none).alias("names"))
