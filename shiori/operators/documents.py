"""Document records derived from a scan: metadata, status and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id


def status_of(evidence: DataFrame) -> DataFrame:
    """(document_id, status, n_evidence, warnings) of evidence rows (document_id, warning).

    A warning that begins with 'failed' or 'deferred' decides the status, in that order; any other makes
    it partial; without warnings it is success. The warnings are distinct and sorted. Only rows with a
    warning are gathered per document, never its evidence.
    """
    warned = evidence.where(F.col("warning").isNotNull()).groupBy("document_id").agg(F.array_sort(F.collect_set("warning")).alias("warnings"))
    counts = evidence.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    starts = lambda word: F.exists("warnings", lambda w: w.startswith(word))
    status = F.when(F.col("warnings").isNull(), "success").when(starts("failed"), "failed").when(starts("deferred"), "deferred").otherwise("partial")
    none = F.array().cast("array<string>")
    rows = counts.where(F.col("document_id").isNotNull()).join(warned, "document_id", "left")
    return rows.select("document_id", status.alias("status"), "n_evidence", F.coalesce("warnings", none).alias("warnings"))


def records(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Document records of scanned files (relative_path, file_name, extension, media_type, size_bytes,
    modified_at, content) and what was parsed from them (path, warning): id, source, status, warnings."""
    hashed = files.withColumn("sha256", F.sha2("content", 256)).drop("content")
    found = status_of(parsed.select(F.col("path").alias("document_id"), "warning")).withColumnRenamed("document_id", "relative_path")
    document = stable_id("doc", relative_path=F.col("relative_path"), source_sha256=F.col("sha256"))
    source = F.struct("relative_path", "file_name", "extension", "media_type", "size_bytes", "sha256", "modified_at")
    extraction = F.struct(F.coalesce("status", F.lit("pending")).alias("status"), F.concat(F.lit("probe_"), F.col("extension")).alias("parser"), "warnings")
    return hashed.join(found, "relative_path", "left").select(document.alias("document_id"), source.alias("source"), extraction.alias("extraction"), "n_evidence")


def validate_inputs(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(relative_path, check): wanted inputs (relative_path) that can't be used: missing, repeated, or outside the root."""
    once = wanted.groupBy("relative_path").agg(F.count(F.lit(1)).alias("n"))
    outside = once.where(F.col("relative_path").startswith("/") | F.array_contains(F.split("relative_path", "/"), ".."))
    checks = {"repeated": once.where(F.col("n") > 1), "outside the root": outside, "missing": once.join(listing.select("relative_path"), "relative_path", "left_anti")}
    out = None
    for name, bad in checks.items():
        rows = bad.select("relative_path", F.lit(name).alias("check"))
        out = rows if out is None else out.unionByName(rows)
    return out
