"""Validators: each gives its violations as rows (check, record_id); a clean table gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ids import content_hash, ordered, stable_id
from .joins import hot_join

# Types of units and statuses of an extraction.
UNIT_TYPES = ["paragraph_chunk", "table_row", "slide_text", "page_text"]
# The version of the record schemas and the builder of units.
SCHEMA_VERSION, BUILDER = "0.1", "search-unit-builder"
STATUSES = ["pending", "success", "partial", "deferred", "failed"]


def union(checks: dict[str, DataFrame], key: str) -> DataFrame:
    """The distinct (check, record_id) of several violation tables, which all have the key column."""
    out = None
    for name, bad in checks.items():
        rows = bad.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("record_id"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def assert_clean(violations: DataFrame) -> None:
    """Raise with the first violations, if there are any."""
    rows = violations.limit(20).collect()
    if rows:
        raise ValueError("violations: " + "; ".join(f"{r['check']}: {r['record_id']}" for r in rows))


# The fields that the parts of a search unit may have.
UNIT_FIELDS = {
    "": ["schema_version", "record_type", "search_unit_id", "document_id", "unit_type", "source_evidence_ids", "locator", "text", "context", "provenance"],
    "text": ["search_text", "sha256", "char_count"],
    "provenance": ["builder", "builder_version", "generated_at", "deterministic"],
    "locator": ["page_number", "slide_number", "sheet_name", "table_index", "shape_id", "row_index", "paragraph_start", "paragraph_end"],
    "context": ["heading_text", "container_kind", "container_heading_text", "container_heading_evidence_ids", "header_labels", "header_evidence_ids", "header_method", "is_header_candidate"],
}


def unexpected_fields(schema: StructType, allowed: dict[str, list[str]]) -> list[str]:
    """Names of fields (nested ones as a.b) that a table has beyond the allowed ones of its parts; '' is the top."""
    out = [f.name for f in schema.fields if f.name not in allowed[""]]
    for part, names in allowed.items():
        if part and part in schema.names and isinstance(schema[part].dataType, StructType):
            out += [f"{part}.{f.name}" for f in schema[part].dataType.fields if f.name not in names]
    return sorted(out)


def repeated(df: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Keys that stand for different contents."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*content)).alias("n")).where(F.col("n") > 1)


def _versions(df: DataFrame, kind: str, required: list[str]) -> dict[str, DataFrame]:
    """Records of another version or type, and those without a field they need."""
    own = F.coalesce((F.col("schema_version") == SCHEMA_VERSION) & (F.col("record_type") == kind), F.lit(False))
    lacking = F.lit(False)
    for name in required:
        lacking = lacking | F.col(name).isNull()
    return {"schema version or record type wrong": df.where(~own), "required field missing": df.where(lacking)}


def _malformed(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(key).rlike(f"^{prefix}_[0-9a-f]{{16,64}}$"), F.lit(False)))


def documents(df: DataFrame, recompute_ids: bool = True) -> DataFrame:
    """Checks within the documents. recompute_ids: whether an id must be the hash of what it stands for; unset
    it for tables whose ids come from elsewhere."""
    path, sha = F.col("source.relative_path"), F.col("source.sha256")
    checks = _versions(df, "document", ["document_id", "source", "extraction"]) | {
        "document id malformed": _malformed(df, "document_id", "doc"),
        "status unknown": df.where(~F.coalesce(F.col("extraction.status").isin(STATUSES), F.lit(False))),
        "document id ambiguous": repeated(df.withColumn("path", path), "document_id", ["path"]),
    }
    if recompute_ids:
        checks["document id unstable"] = df.where(~F.col("document_id").eqNullSafe(stable_id("doc", relative_path=path, source_sha256=sha)))
    return union(checks, "document_id")


def source_files(df: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose source isn't below the root, is missing, or has other bytes than recorded; files:
    path (relative to the root), sha256, size_bytes."""
    source = df.select("document_id", F.col("source.relative_path").alias("path"), F.col("source.sha256").alias("sha"), F.col("source.size_bytes").alias("size"))
    known = files.groupBy("path").agg(F.max("sha256").alias("sha256"), F.max("size_bytes").alias("size_bytes"))
    found = source.join(known.withColumn("there", F.lit(True)), "path", "left")
    outside = F.coalesce(F.col("path").rlike(r"(^/)|(^|/)\.\.(/|$)"), F.lit(True))
    return union(
        {
            "source path leaves the root": source.where(outside),
            "source file missing": found.where(~outside & F.col("there").isNull()),
            "source hash wrong": found.where(F.col("there") & ~F.col("sha").eqNullSafe(F.col("sha256"))),
            "source size wrong": found.where(F.col("there") & ~F.col("size").eqNullSafe(F.col("size_bytes"))),
        },
        "document_id",
    )


def evidence(df: DataFrame, documents: DataFrame, payload_hash: bool = True, recompute_ids: bool = True) -> DataFrame:
    """Checks of the evidence: versions, ids, content hashes, documents and parents; documents: document_id.

    A content's hash is that of its payload; with payload_hash unset, of its text alone, as some builders
    write it. recompute_ids as in documents().
    """
    text, sha = F.col("content.raw_text"), F.col("content.sha256")
    payload = content_hash(text, F.col("content.raw_value"), F.col("content.content_ref"))
    digest = payload if payload_hash else F.sha2(text, 256)
    narrow = df.select("evidence_id", "document_id", "parent_evidence_id").distinct()
    own = narrow.where(F.col("parent_evidence_id").isNotNull())
    # One row per id, so that a parent of many meets them without gathering anywhere.
    parents = narrow.groupBy(F.col("evidence_id").alias("parent_evidence_id")).agg(F.min("document_id").alias("low"), F.max("document_id").alias("high"))
    met = hot_join(own, parents, ["parent_evidence_id"], "inner")
    checks = _versions(df, "evidence", ["evidence_id", "document_id", "evidence_type", "location", "content", "provenance"]) | {
        "evidence id malformed": _malformed(df, "evidence_id", "ev"),
        "text hash wrong": df.where(digest.isNotNull() & sha.isNotNull() & (digest != sha)),
        "evidence id ambiguous": repeated(df.withColumn("text", text), "evidence_id", ["document_id", "parent_evidence_id", "text"]),
        "document dangling": hot_join(narrow.where(F.col("document_id").isNotNull()), documents.select("document_id").distinct(), ["document_id"], "left_anti"),
        "parent dangling": hot_join(own, parents, ["parent_evidence_id"], "left_anti"),
        "parent in another document": met.where((F.col("document_id") != F.col("low")) | (F.col("document_id") != F.col("high"))),
    }
    if recompute_ids:
        location = ordered(F.col("location"), df.schema["location"].dataType)
        checks["evidence id unstable"] = df.where(~F.col("evidence_id").eqNullSafe(stable_id("ev", document_id=F.col("document_id"), evidence_type=F.col("evidence_type"), location=location, content_sha256=sha)))
        checks["content without payload"] = df.where(payload.isNull())
    return union(checks, "evidence_id")


def relations(df: DataFrame, nodes: DataFrame, recompute_ids: bool = True) -> DataFrame:
    """Relations whose ends or supporting evidence are missing; nodes: record_type, record_id."""
    ends = {f: df.select("relation_id", F.col(f"{f}.record_type").alias("record_type"), F.col(f"{f}.record_id").alias("record_id")) for f in ("from_ref", "to_ref")}
    known = nodes.distinct()
    checks = {f"{f} missing": rows.where(F.col("record_id").isNull()) for f, rows in ends.items()}
    checks |= {f"{f} of another type": rows.where(~F.coalesce(F.col("record_type").isin("document", "evidence"), F.lit(False))) for f, rows in ends.items()}
    checks |= {f"{f} dangling": hot_join(rows.where(F.col("record_id").isNotNull()), known, ["record_type", "record_id"], "left_anti") for f, rows in ends.items()}
    support = df.select("relation_id", F.lit("evidence").alias("record_type"), F.explode("supporting_evidence_ids").alias("record_id")).where(F.col("record_id").isNotNull())
    checks["supporting evidence dangling"] = hot_join(support, known, ["record_type", "record_id"], "left_anti")
    checks["relation to itself"] = df.where(F.col("from_ref.record_id") == F.col("to_ref.record_id"))
    checks["relation id malformed"] = _malformed(df, "relation_id", "rel")
    if recompute_ids:
        ref = lambda f: ordered(F.col(f), df.schema[f].dataType)
        parts = {"class": F.col("relation_class"), "type": F.col("relation_type"), "from": ref("from_ref"), "to": ref("to_ref"), "generator": F.col("provenance.generated_by"), "generator_version": F.col("provenance.generator_version")}
        checks["relation id unstable"] = df.where(~F.col("relation_id").eqNullSafe(stable_id("rel", **parts)))
    return union(checks, "relation_id")


def search_units(df: DataFrame, documents: DataFrame, evidence: DataFrame, recompute_ids: bool = True, builder: str | None = BUILDER) -> DataFrame:
    """Checks of the units: ids, types, hashes, lengths, sources; documents: document_id; evidence: evidence_id,
    document_id. builder: the one that every unit must come from, if any."""
    text, sources = F.col("text.search_text"), F.col("source_evidence_ids")
    lacking = lambda names: df.where(F.size(F.array_except(names, sources)) > 0)
    each = df.select("search_unit_id", "document_id", F.explode(sources).alias("evidence_id")).where(F.col("evidence_id").isNotNull())
    own = evidence.select("evidence_id", "document_id").distinct()
    checks = {
        "unit id malformed": _malformed(df, "search_unit_id", "su"),
        "unit id ambiguous": repeated(df.withColumn("t", text), "search_unit_id", ["document_id", "unit_type", "t"]),
        "unit type unknown": df.where(~F.coalesce(F.col("unit_type").isin(UNIT_TYPES), F.lit(False))),
        "text hash wrong": df.where(F.sha2(text, 256) != F.col("text.sha256")),
        "text empty": df.where(F.coalesce(text, F.lit("")) == ""),
        "char count wrong": df.where(~F.col("text.char_count").eqNullSafe(F.length(text).cast("long"))),
        "no sources": df.where(F.coalesce(F.size(sources), F.lit(0)) < 1),
        "source repeated": df.where(F.size(sources) != F.size(F.array_distinct(sources))),
        "document dangling": hot_join(df.where(F.col("document_id").isNotNull()).select("search_unit_id", "document_id"), documents.select("document_id").distinct(), ["document_id"], "left_anti"),
        "source dangling or of another document": hot_join(each, own, ["evidence_id", "document_id"], "left_anti"),
        "header not among sources": lacking("context.header_evidence_ids"),
        "heading not among sources": lacking("context.container_heading_evidence_ids"),
    }
    if builder:
        checks["provenance wrong"] = df.where(~F.coalesce((F.col("provenance.builder") == builder) & F.col("provenance.deterministic"), F.lit(False)))
    if recompute_ids:
        locator = ordered(F.col("locator"), df.schema["locator"].dataType)
        identity = stable_id("su", document_id=F.col("document_id"), unit_type=F.col("unit_type"), source_evidence_ids=sources, locator=locator, text_sha256=F.sha2(text, 256), builder=F.col("provenance.builder"), builder_version=F.col("provenance.builder_version"))
        checks["unit id unstable"] = df.where(~F.col("search_unit_id").eqNullSafe(identity))
    return union(checks, "search_unit_id")


def eval_cases(df: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Checks of evaluation cases: eval_case_id, record_type, query, relevant_search_unit_ids, provenance (method,
    generator, generator_version), review (reviewed, source_locations). units: search_unit_id of the index."""
    relevant = F.col("relevant_search_unit_ids")
    identity = stable_id("qe", query=F.col("query"), relevant_search_unit_ids=relevant, method=F.col("provenance.method"), generator=F.col("provenance.generator"), generator_version=F.col("provenance.generator_version"))
    bare = F.forall(relevant, lambda x: F.coalesce(x.rlike("^su_[0-9a-f]{16,64}$"), F.lit(False)))
    reviewed = F.coalesce(F.col("review.reviewed") & (F.size("review.source_locations") > 0), F.lit(False))
    checks = {
        "case id malformed": _malformed(df, "eval_case_id", "qe"),
        "record type wrong": df.where(~F.col("record_type").eqNullSafe(F.lit("retrieval_eval_case"))),
        "case id repeated": df.groupBy("eval_case_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1),
        "query empty": df.where(F.trim(F.coalesce("query", F.lit(""))) == ""),
        "relevance set empty or repeated": df.where((F.coalesce(F.size(relevant), F.lit(0)) < 1) | (F.size(relevant) != F.size(F.array_distinct(relevant)))),
        "relevant id malformed": df.where(~F.coalesce(bare, F.lit(True))),
        "case id unstable": df.where(~F.col("eval_case_id").eqNullSafe(identity)),
        "review lacks evidence": df.where((F.col("provenance.method") == "human_reviewed") & ~reviewed),
    }
    if units is not None:
        each = df.select("eval_case_id", F.explode(relevant).alias("search_unit_id")).where(F.col("search_unit_id").isNotNull())
        checks["relevant unit not in the index"] = hot_join(each, units.select("search_unit_id").distinct(), ["search_unit_id"], "left_anti")
    return union(checks, "eval_case_id")


def lexical_index(terms: DataFrame, postings: DataFrame, units: DataFrame) -> DataFrame:
    """Terms whose recorded document frequency differs from their postings, postings of missing units, repeats."""
    counts = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    recorded = terms.join(counts, "term_id", "left")
    return union(
        {
            "document frequency wrong": recorded.where(~F.col("document_frequency").eqNullSafe(F.coalesce("n", F.lit(0)).cast("long"))),
            "posting of a missing unit": hot_join(postings.select("term_id", "doc_rowid"), units.select(F.col("unit_seq").alias("doc_rowid")).distinct(), ["doc_rowid"], "left_anti"),
            "posting repeated": postings.groupBy("term_id", "doc_rowid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1),
            "frequency not positive": postings.where(F.coalesce("term_frequency", F.lit(0)) <= 0),
            # Counted by term before the join, so a common term is one row.
            "term of a posting missing": counts.join(terms.select("term_id").distinct(), "term_id", "left_anti"),
            "term repeated": terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("term_id").alias("term_id")).where(F.col("n") > 1),
        },
        "term_id",
    )


def semantic_index(df: DataFrame, units: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Rows of another model or size, vectors that are null, not finite, zero or not of unit length."""
    finite = F.forall("matrix", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate("matrix", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    whole = df.where(F.col("matrix").isNotNull())
    return union(
        {
            "other model": df.where(~F.col("model").eqNullSafe(F.lit(model))),
            "vector missing": df.where(F.col("matrix").isNull()),
            "dimensions wrong": whole.where(F.size("matrix") != dimensions),
            "not finite": whole.where(~finite),
            "length not one": whole.where(finite & (F.abs(norm - 1) > 1.1e-5)),
            "unit missing": df.join(units.select("search_unit_id").distinct(), "search_unit_id", "left_anti"),
        },
        "row_no",
    )


def chart_tables(long: DataFrame) -> DataFrame:
    """Series without a point for each x of their chart, points that have no value though marked exact, and the reverse.

    long: chart_id, series_id, x, y, status.
    """
    axis = long.groupBy("chart_id").agg(F.count_distinct("x").alias("wanted"))
    have = long.groupBy("chart_id", "series_id").agg(F.count_distinct("x").alias("n"), F.count(F.lit(1)).alias("rows"))
    return union(
        {
            "points missing": have.join(axis, "chart_id").where(F.col("n") != F.col("wanted")),
            "point repeated": have.where(F.col("n") != F.col("rows")),
            "unresolved with a value": long.where((F.col("status") == "unresolved") & F.col("y").isNotNull()),
            "exact without a value": long.where((F.col("status") == "exact") & F.col("y").isNull()),
            "status unknown": long.where(~F.coalesce(F.col("status").isin("exact", "unresolved", "estimated"), F.lit(False))),
        },
        "chart_id",
    )


def chart_records(df: DataFrame) -> DataFrame:
    """Checks of chart tables as charts.chart_records() makes them: id, axes, series, points, provenance."""
    shas = [F.col(f"provenance.{n}") for n in ("chart_sha256", "code_sha256", "data_sha256")]
    axes = F.transform("axes", lambda a: a["axis_id"])
    lacking = F.lit(False)
    for sha in shas:
        lacking = lacking | ~F.coalesce(sha.rlike("^[0-9a-f]{64}$"), F.lit(False))
    points = F.flatten(F.transform("series", lambda s: s["points"]))
    return union(
        {
            "chart id malformed": df.where(~F.coalesce(F.col("chart_table_id").rlike("^ct_[0-9a-f]{24}$"), F.lit(False))),
            "chart id unstable": df.where(~F.col("chart_table_id").eqNullSafe(F.concat(F.lit("ct_"), F.substring(F.sha2(F.concat_ws("\0", *shas), 256), 1, 24)))),
            "provenance hash malformed": df.where(lacking),
            "axis missing or repeated": df.where(~F.array_contains(axes, "x") | ~F.array_contains(axes, "y_left") | (F.size(axes) != F.size(F.array_distinct(axes)))),
            "series on an unknown axis": df.where(F.exists("series", lambda s: ~F.array_contains(axes, s["axis_id"]))),
            "series count wrong": df.where((F.col("detected_series_count") != F.col("output_series_count")) | (F.col("output_series_count") != F.size("series"))),
            "points missing": df.where(F.exists("series", lambda s: ~F.transform(s["points"], lambda p: p["x"]).eqNullSafe(F.col("x_values")))),
            "unresolved with a value": df.where(F.exists(points, lambda p: (p["status"] == "unresolved") & p["y"].isNotNull())),
            "exact without a value": df.where(F.exists(points, lambda p: (p["status"] == "exact") & p["y"].isNull())),
        },
        "chart_table_id",
    )


def visual_analyses(df: DataFrame) -> DataFrame:
    """df: analysis_id, stage outputs transcription, visual_state, fusion (JSON strings), status, retry_count."""
    stages = ["transcription", "visual_state", "fusion"]
    broken = {f"{s} is no object": df.where(F.get_json_object(F.col(s), "$").isNull() | ~F.trim(F.coalesce(F.col(s), F.lit(""))).startswith("{")) for s in stages}
    return union(
        {
            **broken,
            "status unknown": df.where(~F.coalesce(F.col("status").isin("verified", "needs_retry", "unresolved"), F.lit(False))),
            "retry count out of range": df.where(~F.coalesce(F.col("retry_count").between(0, 2), F.lit(False))),
            "verified with a broken stage": df.where((F.col("status") == "verified") & F.greatest(*[F.col(s).isNull().cast("int") for s in stages]).cast("boolean")),
        },
        "analysis_id",
    )
