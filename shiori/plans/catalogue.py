"""The library's operators as queries over a folder of tables: (spark, folder) -> DataFrame.

Questions for the search queries are the self-retrieval cases of all units whose unit_seq is divisible by
20, as are those units the vector queries; self_eval_cases is the sample of 100 cases. The older search
path asks every document whose doc_id is divisible by 20.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import content_hash, stable_id
from ..operators import answers, charts, derive, documents, evaluation, fusion, glossary, index, legacy, lexical, mining, quality, semantic
from ..session import cut, fingerprint, lasting_path, remembered
from ..sources import indexes, records
from ..sources.tables import table
from ..streaming import incremental

MODEL, DIMENSIONS = "embedstub-96", 96


def tokenize_units(spark: SparkSession, folder: str) -> DataFrame:
    tokens = index.tokenize(records.units(spark, folder).select("unit_seq", "search_text"))
    return tokens.select("unit_seq", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def tokenize_documents(spark: SparkSession, folder: str) -> DataFrame:
    tokens = index.tokenize(table(spark, folder, "documents", "doc_id", "text"), "text", "b")
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def unit_postings(spark: SparkSession, folder: str) -> DataFrame:
    return index.term_frequencies(records.units(spark, folder)).select("term", "unit_seq", "term_frequency")


def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return index.term_frequencies(records.units(spark, folder)).groupBy("term").agg(F.count(F.lit(1)).alias("document_frequency"), F.sum("term_frequency").alias("occurrences"))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    lengths = index.term_frequencies(records.units(spark, folder)).groupBy("unit_seq").agg(F.sum("term_frequency").alias("n"))
    return lengths.agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("total_length"), F.round(F.avg("n"), 6).alias("average_length"))


def unit_counts(spark: SparkSession, folder: str) -> DataFrame:
    units = records.units(spark, folder)
    sets = units.groupingSets([["unit_type"], ["document_id"]], "unit_type", "document_id").agg(F.count(F.lit(1)).alias("n_units"), F.grouping("unit_type").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "unit_type").otherwise("document_id").alias("kind"), F.coalesce("unit_type", "document_id", F.lit("")).alias("value"), "n_units")


def _stored(spark: SparkSession, folder: str, name: str, make):
    """A table's lexical index: at its first use in a session written with a manifest, read back and checked."""
    source = fingerprint(spark, f"{folder}/{name}.parquet")

    def write() -> str:
        path = lasting_path(spark, "index")
        indexes.write_lexical(make(), path, source)
        return path

    kind = "a" if name == "search_units" else "b"
    return remembered(spark, f"{name} {source}", lambda: indexes.read_lexical(spark, write(), kind, source))


def _unit_index(spark: SparkSession, folder: str) -> index.LexicalIndex:
    return _stored(spark, folder, "search_units", lambda: index.build(records.units(spark, folder)))


def _chunk_index(spark: SparkSession, folder: str) -> index.LexicalIndex:
    return _stored(spark, folder, "documents", lambda: legacy.chunk_index(_chunks(spark, folder)))


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    units = _unit_index(spark, folder).documents.where(F.col("unit_seq") % 20 == 0)
    return cut(evaluation.self_retrieval(units, max_cases=None))


def _queries(cases: DataFrame) -> DataFrame:
    return cases.select(F.col("eval_case_id").alias("query_id"), "query")


def self_eval_cases(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.self_retrieval(records.units(spark, folder)).select("eval_case_id", "query", "relevant_id", "category")


def _bm25(spark: SparkSession, folder: str, unit_types: list[str] | None = None) -> DataFrame:
    hits = lexical.search_bm25(_unit_index(spark, folder), _queries(_cases(spark, folder)), unit_types=unit_types)
    return hits.select("query_id", "rank", "unit_seq", F.round("lexical_score", 6).alias("score"), "matched_terms")


def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    return _bm25(spark, folder)


def bm25_type_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _bm25(spark, folder, ["paragraph_chunk", "page_text"])


def _reranked(spark: SparkSession, folder: str, cases: DataFrame, top_k: int = 10) -> DataFrame:
    return lexical.search(_unit_index(spark, folder), _queries(cases), top_k)


def bm25_rerank(spark: SparkSession, folder: str) -> DataFrame:
    hits = _reranked(spark, folder, _cases(spark, folder))
    return hits.select("query_id", "rank", "search_unit_id", F.round("score", 6).alias("score"), F.round("field_value_bonus", 6).alias("bonus"), F.round("parent_context_penalty", 6).alias("penalty"), F.size("exact_field_value_matches").alias("n_values"), "matched_terms", F.md5("text").alias("snippet_md5"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "semantic_index").where(F.col("search_unit_id").isNotNull() & (F.col("model") == MODEL))
    usable = semantic.usable(rows.select("row_no", "unit_seq", "search_unit_id", F.col("matrix").alias("vector")), DIMENSIONS)
    return usable.groupBy("unit_seq", "search_unit_id").agg(F.min_by("vector", "row_no").alias("vector"))


def semantic_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = cut(_vectors(spark, folder))
    queries = vectors.where(F.col("unit_seq") % 20 == 0).select(F.col("unit_seq").alias("query_id"), "vector")
    return semantic.search(vectors, queries, 10, DIMENSIONS).select("query_id", "rank", "unit_seq", F.round("similarity", 6).alias("similarity"))


def semantic_type_filter(spark: SparkSession, folder: str) -> DataFrame:
    """semantic_topk among table rows alone; the queries stay all."""
    vectors = cut(_vectors(spark, folder))
    queries = vectors.where(F.col("unit_seq") % 20 == 0).select(F.col("unit_seq").alias("query_id"), "vector")
    types = records.units(spark, folder).select("unit_seq", "unit_type")
    return semantic.search(vectors, queries, 10, DIMENSIONS, types, ["table_row"]).select("query_id", "rank", "unit_seq", F.round("similarity", 6).alias("similarity"))


def embedding_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("unit_seq"), F.col("embedding").alias("vector"))
    queries = vectors.where(F.col("unit_seq") % 20 == 0).select(F.col("unit_seq").alias("query_id"), "vector")
    return semantic.search(vectors, queries, 5, 64).select("query_id", "rank", F.col("unit_seq").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def _hybrid(spark: SparkSession, folder: str, adaptive: bool) -> DataFrame:
    cases = _cases(spark, folder)
    lexical_hits = _reranked(spark, folder, cases, 50)
    vectors = cut(_vectors(spark, folder))
    asked = cases.join(vectors, "unit_seq").select(F.col("eval_case_id").alias("query_id"), "vector")
    names = vectors.select("unit_seq", "search_unit_id")
    semantic_hits = semantic.search(vectors, asked, 50, DIMENSIONS).join(names, "unit_seq")
    return fusion.hybrid(lexical_hits, semantic_hits, _queries(cases), adaptive=adaptive).select("query_id", "rank", "search_unit_id", "score", "lexical_rank", "semantic_rank")


def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder, False)


def hybrid_adaptive(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder, True)


def _relevance(cases: DataFrame) -> DataFrame:
    return cases.select(F.col("eval_case_id").alias("query_id"), "category", "relevant_id")


def retrieval_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    cases = _cases(spark, folder)
    return evaluation.outcomes(_reranked(spark, folder, cases), _relevance(cases))


def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    scores = evaluation.metrics(retrieval_outcomes(spark, folder))
    return scores.select("category", "n_cases", *[F.round(c, 6).alias(c) for c in scores.columns if c not in ("category", "n_cases")])


def missing_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Units that the vector index doesn't hold, so that no search of it can find them."""
    relevance = records.units(spark, folder).select(F.col("search_unit_id").alias("relevant_id"))
    return evaluation.missing_targets(relevance, table(spark, folder, "semantic_index", "search_unit_id"))


def remap_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The units of the table against newly derived ones, matched by document, type and text."""
    old = records.units(spark, folder)
    cases = old.select(F.col("search_unit_id").alias("eval_case_id"), F.col("search_unit_id").alias("relevant_id"))
    new = cut(derive.search_units(records.evidence(spark, folder)))
    return evaluation.remap(cases, old, new, ["document_id", "unit_type", "search_text"]).select("relevant_id", "n_candidates", F.col("new_id").isNotNull().alias("found"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").where(F.col("text").isNotNull())
    pieces = derive.sliding_chunks(documents.select("doc_id", "project", "file_name", "text"))
    path = F.concat(F.coalesce("project", F.lit("共通")), F.lit("/"), F.coalesce("file_name", F.lit("")))
    return pieces.select((F.col("doc_id") * 10_000 + F.col("piece_no")).alias("cid"), path.alias("path"), "project", F.col("file_name").alias("filename"), F.concat(F.lit("chunk "), F.col("piece_no").cast("string")).alias("location"), F.col("piece").alias("text"))


def sliding_chunks(spark: SparkSession, folder: str) -> DataFrame:
    pieces = derive.sliding_chunks(table(spark, folder, "documents", "doc_id", "text"))
    return pieces.select("doc_id", "piece_no", "start", F.length("piece").alias("n_chars"), F.md5("piece").alias("piece_md5"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(F.col("text").isNotNull() & (F.col("doc_id") % 20 == 0))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions over the documents: each document with a text whose doc_id is divisible by 20, with the project's
    name before the whole text."""
    documents = _asked(spark, folder)
    query = F.concat(F.coalesce("project", F.lit("")), F.lit(" "), T.collapse_space(F.col("text")))
    return documents.select(F.col("doc_id").alias("query_id"), query.alias("query"), F.array().cast("array<string>").alias("names"))


def legacy_search(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunk_index(spark, folder)
    hits = legacy.search(chunks.documents, cut(_questions(spark, folder)), index=chunks)
    return hits.select("query_id", "rank", "cid", F.round("score", 6).alias("score"), F.round("base_score", 6).alias("base_score"))


def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunk_index(spark, folder)
    hits = legacy.search(chunks.documents, cut(_questions(spark, folder)), index=chunks)
    return legacy.context(hits.select("query_id", "rank", "cid"), chunks.documents, 6_000, F.md5).select("query_id", "rank", "cid", "used", F.col("block").alias("block_md5"))


def _glossary(spark: SparkSession, folder: str) -> DataFrame:
    """Short names of the projects: the first two characters stand for the whole."""
    projects = table(spark, folder, "documents", "project").where(F.length("project") > 2).distinct()
    return glossary.build(projects.select(F.substring("project", 1, 2).alias("alias"), F.col("project").alias("canonical"), F.lit(0).alias("ord")))


def glossary_expand(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("query_id"), F.concat(F.coalesce("project", F.lit("")), F.lit(": "), "text").alias("query"))
    return glossary.expand(lines, _glossary(spark, folder)).select("query_id", "expanded", F.array_join("names", ",").alias("names"))


def _unit_rows(units: DataFrame) -> DataFrame:
    return units.select("document_id", F.array_join("source_evidence_ids", ",").alias("sources"), "search_text", F.to_json("locator").alias("locator"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return derive.events(records.evidence(spark, folder))


def paragraph_chunks(spark: SparkSession, folder: str) -> DataFrame:
    units = derive.paragraph_chunks(_events(spark, folder))
    return _unit_rows(units).drop("locator")


def table_row_units(spark: SparkSession, folder: str) -> DataFrame:
    units = derive.table_rows(_events(spark, folder))
    return units.select("document_id", F.array_join("source_evidence_ids", ",").alias("sources"), "search_text", "is_header_candidate", F.array_join("header_labels", "|").alias("header_labels"))


def slide_units(spark: SparkSession, folder: str) -> DataFrame:
    return _unit_rows(derive.slide_texts(_events(spark, folder))).drop("locator")


def page_units(spark: SparkSession, folder: str) -> DataFrame:
    return _unit_rows(derive.page_texts(_events(spark, folder))).drop("locator")


def derived_units(spark: SparkSession, folder: str) -> DataFrame:
    units = derive.search_units(records.evidence(spark, folder))
    return units.select("search_unit_id", "document_id", "unit_type", "sha256", "char_count")


def unit_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """What surrounds each derived unit: its headings, container and header."""
    units = derive.search_units(records.evidence(spark, folder))
    c = lambda name: F.col(f"context.{name}")
    lists = {"container_heading_evidence_ids": ",", "header_labels": "|", "header_evidence_ids": ","}
    return units.select("search_unit_id", *[c(k).alias(k) for k in ("heading_text", "container_kind", "container_heading_text", "header_method", "is_header_candidate")], *[F.array_join(c(k), s).alias(k) for k, s in lists.items()])


def containment_edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "evidence", "evidence_id", "document_id", "parent_evidence_id").distinct()
    return derive.containment_edges(rows).select("relation_id", "from_type", "from_id", "to_id")


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "evidence").select("evidence_id", F.col("content.raw_text").alias("raw_text")).where(F.col("raw_text").isNotNull()).distinct()
    identity = stable_id("ev", content_sha256=F.sha2("raw_text", 256), evidence_id=F.col("evidence_id"))
    return rows.select("evidence_id", content_hash(F.col("raw_text")).alias("content_sha256"), identity.alias("stable_id"))


def cell_positions(spark: SparkSession, folder: str) -> DataFrame:
    cells = derive.cells(_events(spark, folder).where(F.col("kind") == "c"))
    return cells.select("evidence_id", F.replace("container", F.lit("\x1f"), F.lit("/")).alias("container"), "row_no", "column_no", "label")


def display_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.evidence(spark, folder)
    return rows.select("evidence_id", derive.display_value(F.col("raw_text"), F.col("raw_value")).alias("value")).where(F.col("value") != "")


def field_values(spark: SparkSession, folder: str) -> DataFrame:
    units = records.units(spark, folder).select("search_unit_id", "search_text")
    return units.select("search_unit_id", F.array_join(T.field_values(F.col("search_text")), "|").alias("field_values")).where(F.col("field_values") != "")


def snippets(spark: SparkSession, folder: str) -> DataFrame:
    units = records.units(spark, folder)
    return units.select("search_unit_id", T.clip(F.col("search_text"), 40).alias("snippet"), T.collapse_space(F.substring("search_text", 1, 40)).alias("line"))


def leaf_sample(spark: SparkSession, folder: str) -> DataFrame:
    """At most 40 leaves of each document, in order: the sampling scan."""
    rows = records.evidence(spark, folder).where(F.col("document_id").isNotNull() & F.col("evidence_type").isin("table_cell", "paragraph", "text_block"))
    order = Window.partitionBy("document_id").orderBy("seq", "evidence_id")
    return rows.withColumn("leaf_no", F.row_number().over(order)).where(F.col("leaf_no") <= 40).select("document_id", "evidence_id", "leaf_no")


def round_robin_sample(spark: SparkSession, folder: str) -> DataFrame:
    units = records.units(spark, folder).select("unit_type", "unit_seq")
    return evaluation.round_robin(units, "unit_type", "unit_seq", 200)


def _event_days(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.date_format("ts", "d").alias("day"), "event_type", "value")


def chart_groupby(spark: SparkSession, folder: str) -> DataFrame:
    return charts.group_table(_event_days(spark, folder), "day", "value").select("x", "n_rows", F.round("mean", 6).alias("mean"))


def chart_points(spark: SparkSession, folder: str) -> DataFrame:
    long = charts.points(charts.group_table(_event_days(spark, folder), "day", "value", ["event_type"]), "mean")
    return long.select(F.col("event_type").alias("series_id"), "x", F.round("y", 6).alias("y"), "status")


def chart_tables(spark: SparkSession, folder: str) -> DataFrame:
    long = charts.group_table(_event_days(spark, folder), "day", "value", ["event_type"])
    made = charts.assemble(long.select(F.lit("events").alias("chart_id"), F.col("event_type").alias("series_id"), "x", F.col("n_rows").alias("y")))
    return made.select("chart_id", "n_series", "points_per_series", "completeness", F.array_join(F.transform("x_values", lambda x: x.cast("int").cast("string")), ",").alias("x_values"))


def chart_axis(spark: SparkSession, folder: str) -> DataFrame:
    return _event_days(spark, folder).groupBy("event_type").agg(charts.is_day_number("day").alias("is_day"))


def _pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Colours made from keys: an image per return flag."""
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    return rows.select(F.col("l_returnflag").alias("image"), (F.col("l_orderkey") % 256).cast("int").alias("r"), (F.col("l_partkey") * 7 % 256).cast("int").alias("g"), (F.col("l_suppkey") * 13 % 256).cast("int").alias("b"))


def colour_bins(spark: SparkSession, folder: str) -> DataFrame:
    return charts.colour_bins(_pixels(spark, folder), ["image"])


def colour_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found = charts.colour_clusters(charts.colour_bins(_pixels(spark, folder), ["image"]), "image")
    return found.select("image", "cluster_no", *[F.round(c, 6).alias(c) for c in "rgb"], "weight")


def _answered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Answers made from the documents: the expected one is a line's start, the predicted one another's."""
    chunks = _chunk_index(spark, folder)
    questions = cut(_questions(spark, folder))
    known = _asked(spark, folder).select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 12).alias("text"))
    expected = F.when(F.col("query_id") % 3 == 0, F.concat(F.substring("text", 1, 12), F.lit("※"))).otherwise(F.substring("text", 1, 12))
    asked = known.select("query_id", expected.alias("expected"))
    predicted = known.where(F.col("query_id") % 4 != 1).select("query_id", F.when(F.col("query_id") % 2 == 0, F.substring("text", 1, 12)).otherwise("わかりません").alias("predicted"))
    hits = legacy.search(chunks.documents, questions, index=chunks).select("query_id", "cid")
    return asked, predicted, chunks.documents, hits


def diagnose_answers(spark: SparkSession, folder: str) -> DataFrame:
    return answers.diagnose(*_answered(spark, folder)).select("query_id", "in_corpus", "in_top", "automatic", "category")


def answer_categories(spark: SparkSession, folder: str) -> DataFrame:
    return answers.category_counts(answers.diagnose(*_answered(spark, folder)))


def _submission(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderpriority")
    n = F.col("o_orderkey")
    expected = orders.select(n.alias("position"), n.alias("index"))
    answer = F.when(n % 11 == 0, "").when(n % 13 == 0, F.repeat("o_orderpriority", 200)).otherwise(F.col("o_orderpriority"))
    return expected, orders.where(n % 97 != 0).select(n.alias("position"), F.when(n % 17 == 0, n + 1).otherwise(n).alias("index"), answer.alias("answer"))


def submission_check(spark: SparkSession, folder: str) -> DataFrame:
    return answers.submission(*_submission(spark, folder))


def submission_longest(spark: SparkSession, folder: str) -> DataFrame:
    return answers.longest(_submission(spark, folder)[1])


def violations_documents(spark: SparkSession, folder: str) -> DataFrame:
    return quality.documents(table(spark, folder, "source_documents"))


def violations_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return quality.evidence(table(spark, folder, "evidence"), table(spark, folder, "source_documents", "document_id"), payload_hash=False, recompute_ids=False)


def violations_relations(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "source_documents").select(F.lit("document").alias("record_type"), F.col("document_id").alias("record_id")).unionByName(table(spark, folder, "evidence").select(F.lit("evidence").alias("record_type"), F.col("evidence_id").alias("record_id")))
    return quality.relations(table(spark, folder, "relation"), nodes)


def violations_units(spark: SparkSession, folder: str) -> DataFrame:
    return quality.search_units(table(spark, folder, "search_units"), table(spark, folder, "source_documents", "document_id"), table(spark, folder, "evidence", "evidence_id", "document_id"), recompute_ids=False, builder="build_search_units")


def violations_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return quality.lexical_index(table(spark, folder, "terms"), table(spark, folder, "postings"), table(spark, folder, "search_units", "unit_seq"))


def violations_semantic(spark: SparkSession, folder: str) -> DataFrame:
    return quality.semantic_index(table(spark, folder, "semantic_index"), table(spark, folder, "search_units", "search_unit_id"), MODEL, DIMENSIONS)


def coverage_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_documents").select("document_id", "source.extension", "extraction.status", "extraction.warnings").distinct()
    return rows.groupBy("extension", "status").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.coalesce(F.size("warnings"), F.lit(0))).alias("n_warnings"))


def document_status(spark: SparkSession, folder: str) -> DataFrame:
    """Status of each document by the warnings of its evidence; truncated texts count as partial."""
    rows = table(spark, folder, "evidence").select("evidence_id", "document_id", F.col("content.is_truncated").alias("cut"), F.explode_outer("provenance.warnings").alias("w")).distinct()
    each = rows.select("document_id", F.when(F.col("cut"), "truncated").otherwise(F.col("w")).alias("warning"))
    found = documents.status_of(each)
    return found.select("document_id", "status", "n_evidence", F.array_join("warnings", ",").alias("warnings"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour and type: an extension, the same plan as on a stream."""
    return incremental.event_windows(table(spark, folder, "events")).select("window_start", "event_type", "n_events", F.round("total", 6).alias("total"))


def incremental_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to extract anew: the listing has every second hash changed, some statuses don't count as done."""
    listing = table(spark, folder, "source_documents").select(F.col("source.relative_path").alias("path"), F.col("source.sha256").alias("sha256")).distinct()
    manifest = table(spark, folder, "source_documents").select(F.col("source.relative_path").alias("path"), F.when(F.col("source.size_bytes") % 2 == 0, F.col("source.sha256")).otherwise("changed").alias("sha256"), F.col("extraction.status").alias("status"))
    return incremental.pending(listing, manifest)


def mined_dates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents", "doc_id", "text")
    return rows.select("doc_id", F.array_join(mining.dates_in(F.col("text")), ",").alias("dates")).where(F.col("dates") != "")


def password_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_documents").select(F.col("source.relative_path").alias("path"), F.col("source.modified_at").alias("at")).distinct()
    files = rows.select("path", F.array(F.lit("hk"), F.lit("ay")).alias("aliases"), mining.dates_in(F.col("at")).alias("dates"))
    return mining.password_candidates(files)


def path_projects(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_documents").select(F.col("source.relative_path").alias("path")).distinct()
    return rows.select("path", mining.project_of(F.col("path")).alias("project"))


def plain_answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    marked = F.concat(F.lit("<b>"), F.substring("text", 1, 30), F.lit("</b> "))
    return rows.select("doc_id", T.plain_answer(F.when(F.col("doc_id") % 5 == 0, " わかりません。 ").otherwise(marked)).alias("answer"))


QUERIES = [
    tokenize_units, tokenize_documents, unit_postings, term_stats, corpus_stats, unit_counts, self_eval_cases, bm25_search, bm25_type_filter, bm25_rerank,
    semantic_topk, semantic_type_filter, embedding_topk, hybrid_rrf, hybrid_adaptive, retrieval_outcomes, retrieval_metrics, missing_targets, remap_targets, sliding_chunks, legacy_search,
    context_budget, glossary_expand, paragraph_chunks, table_row_units, slide_units, page_units, derived_units, unit_contexts, containment_edges, content_hashes, cell_positions,
    display_values, field_values, snippets, leaf_sample, round_robin_sample, chart_groupby, chart_points, chart_tables, chart_axis, colour_bins, colour_clusters,
    diagnose_answers, answer_categories, submission_check, submission_longest, violations_documents, violations_evidence, violations_relations, violations_units,
    violations_lexical, violations_semantic, document_status, event_windows, coverage_counts, incremental_pending, mined_dates, password_candidates, path_projects, plain_answers,
]
