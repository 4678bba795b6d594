"""Evaluation sets and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import LINE_BREAK, collapse_space, compatible_fold, strip, tokens_a

CUTOFFS = (1, 3, 5, 10)
# Fixed value: the name that enters the cases' ids.
GENERATOR = "self-retrieval-eval-builder"
# The categories of reviewed cases, of which the first four are unit types.
NATIVE = ["paragraph_chunk", "table_row", "slide_text", "page_text"]
CATEGORIES = [*NATIVE, "cross_document", "other"]


def query_of_unit(unit_type: Column, text: Column, query_chars: int = 80) -> Column:
    """A query that the unit should answer: up to 4 field values of a table row, else the text's start."""
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda x: x != "")
    value = lambda x: F.when(F.instr(x, ":") > 0, strip(F.substring(x, F.instr(x, ":") + 1, F.length(x)))).otherwise(x)
    values = F.slice(F.array_distinct(F.filter(F.transform(lines, value), lambda v: v != "")), 1, 4)
    return strip(F.substring(F.when(unit_type == "table_row", F.array_join(values, " ")).otherwise(collapse_space(text)), 1, query_chars))


def round_robin(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first limit rows taken from the groups in turn, each in its order; with the row's turn."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", group).limit(limit)


def self_retrieval(units: DataFrame, max_cases: int | None = 100, query_chars: int = 80, version: str = "0.1.0") -> DataFrame:
    """Cases (eval_case_id, query, relevant_id, category, unit_seq) made from the units themselves.

    Units without a searchable query are passed over. max_cases: of so many units, taken from the types in
    turn; None: of all.
    """
    asked = units.withColumn("query", query_of_unit(F.col("unit_type"), F.col("search_text"), query_chars)).where(F.col("query") != "")
    chosen = asked if max_cases is None else round_robin(asked, "unit_type", "unit_seq", max_cases)
    searchable = chosen.withColumn("f", compatible_fold("query")).where(F.size(tokens_a(F.col("f"))) > 0)
    case = stable_id("qe", generator=F.lit(GENERATOR), generator_version=F.lit(version), method=F.lit("self_retrieval"), query=F.col("query"), relevant_search_unit_ids=F.array("search_unit_id"))
    return searchable.select(case.alias("eval_case_id"), "query", F.col("search_unit_id").alias("relevant_id"), F.col("unit_type").alias("category"), "unit_seq")


def outcomes(hits: DataFrame, relevance: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Per case: category, number of relevant units, first relevant rank, relevant hits up to each cutoff.

    hits: query_id, rank, search_unit_id; relevance: query_id, category, relevant_id (several rows a case).
    Relevance is looked up only after ranking.
    """
    joined = relevance.distinct().join(hits.select("query_id", F.col("search_unit_id").alias("relevant_id"), "rank"), ["query_id", "relevant_id"], "left")
    counts = [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"hits_{k}") for k in cutoffs]
    return joined.groupBy("query_id", "category").agg(F.count(F.lit(1)).alias("n_relevant"), F.min("rank").alias("first_rank"), *counts)


def metrics(cases: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, by_category: bool = True) -> DataFrame:
    """MRR, Hit@k and Recall@k, over all cases (category 'all') and by category. A missed case counts 0."""
    values = [F.count(F.lit(1)).alias("n_cases"), F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr")]
    for k in cutoffs:
        values += [F.avg((F.col(f"hits_{k}") > 0).cast("double")).alias(f"hit_{k}"), F.avg(F.col(f"hits_{k}") / F.col("n_relevant")).alias(f"recall_{k}")]
    if not by_category:
        return cases.agg(*values)
    sets = cases.groupingSets([[], ["category"]], "category").agg(*values, F.grouping("category").alias("g"))
    return sets.select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), *[c for c in sets.columns if c not in ("g", "category")])


def missing_targets(relevance: DataFrame, units: DataFrame) -> DataFrame:
    """Relevant ids that no unit has."""
    return relevance.select(F.col("relevant_id").alias("search_unit_id")).distinct().join(units.select("search_unit_id"), "search_unit_id", "left_anti")


def remap(cases: DataFrame, old_units: DataFrame, new_units: DataFrame, signature: list[str]) -> DataFrame:
    """(eval_case_id, relevant_id, new_id, n_candidates): each old id's new one by the units' signature columns.

    new_id is set only where exactly one new unit has the signature.
    """
    old = cases.select("eval_case_id", "relevant_id").join(old_units.select(F.col("search_unit_id").alias("relevant_id"), *signature), "relevant_id", "left")
    new = new_units.groupBy(*signature).agg(F.count_distinct("search_unit_id").alias("n"), F.min("search_unit_id").alias("one"))
    same = None
    a, b = old.alias("a"), new.alias("b")
    for c in signature:
        equal = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        same = equal if same is None else same & equal
    return a.join(b, same, "left").select("eval_case_id", "relevant_id", F.when(F.col("n") == 1, F.col("one")).alias("new_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"))


def review_violations(drafts: DataFrame, units: DataFrame) -> DataFrame:
    """(eval_case_id, check): what keeps reviewed cases from use.

    drafts: eval_case_id, query, relevant_ids, category, reviewed, method, source_locations.
    """
    folded = drafts.withColumn("f", compatible_fold("query"))
    relevant = drafts.select("eval_case_id", "category", F.explode("relevant_ids").alias("search_unit_id"))
    placed = relevant.join(units.select("search_unit_id", "unit_type"), "search_unit_id", "left")
    checks = {
        "query has no terms": folded.where(F.size(tokens_a(F.coalesce(F.col("f"), F.lit("")))) == 0),
        "no relevant unit": drafts.where(F.coalesce(F.size("relevant_ids"), F.lit(0)) < 1),
        "relevant unit repeated": drafts.where(F.size("relevant_ids") != F.size(F.array_distinct("relevant_ids"))),
        "unknown category": drafts.where(~F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False))),
        "not reviewed": drafts.where(~F.coalesce("reviewed", F.lit(False)) | (strip(F.coalesce("method", F.lit(""))) == "")),
        "source locations repeated or missing": drafts.where((F.coalesce(F.size("source_locations"), F.lit(0)) < 1) | (F.size("source_locations") != F.size(F.array_distinct("source_locations")))),
        "relevant unit does not exist": placed.where(F.col("unit_type").isNull()),
        "category differs from the unit's type": placed.where(F.col("category").isin(NATIVE) & (F.col("unit_type") != F.col("category"))),
        "query repeated": drafts.join(drafts.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "query", "left_semi"),
    }
    out = None
    for name, bad in checks.items():
        rows = bad.select("eval_case_id", F.lit(name).alias("check")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out
