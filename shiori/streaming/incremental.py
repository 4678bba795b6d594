"""Incremental processing: what is left to do, file streams, and idempotent upserts of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

DONE = ["success", "partial", "deferred"]


def pending(listing: DataFrame, manifest: DataFrame, root: str | None = None, version: str | None = None, corrupt: DataFrame | None = None) -> DataFrame:
    """Rows of listing (path, sha256) that no finished manifest row (path, sha256, status) covers.

    With root or version, manifest rows (source_root, extractor_version) of another root or extractor don't
    count, nor do those whose document_id is among corrupt (sinks.corrupt_shards): both are done again.
    """
    done = manifest.where(F.col("status").isin(DONE))
    if root is not None:
        done = done.where(F.col("source_root") == root)
    if version is not None:
        done = done.where(F.col("extractor_version") == version)
    if corrupt is not None:
        done = done.join(corrupt.select("document_id").distinct(), "document_id", "left_anti")
    done = done.select("path", "sha256").distinct()
    return listing.distinct().join(done, ["path", "sha256"], "left_anti")


def build_status(manifest: DataFrame, listing: DataFrame) -> str:
    """complete, complete_with_failures or in_progress."""
    failed = F.count_if(F.col("status") == "failed")
    left = pending(listing, manifest.withColumn("status", F.when(F.col("status") == "failed", "success").otherwise(F.col("status")))).limit(1).count()
    if left:
        return "in_progress"
    return "complete_with_failures" if manifest.agg(failed.alias("n")).first()["n"] else "complete"


def require_complete(status: str, allow_failures: bool = False) -> None:
    """Raise unless a build has come to its end, as what is built on it must demand."""
    if status != "complete" and not (allow_failures and status == "complete_with_failures"):
        raise RuntimeError(f"the build is {status}")


def fail_fast(manifest: DataFrame) -> None:
    """Raise with the first failed documents (path, error), for runs that stop at a failure."""
    rows = manifest.where(F.col("status") == "failed").orderBy("path").limit(5).collect()
    if rows:
        raise RuntimeError("failed to extract " + "; ".join(f"{r['path']}: {r['error']}" for r in rows))


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; blank lines are passed over. A malformed one raises with its file and line number."""
    marked = StructType([*schema.fields, StructField("_malformed", StringType())])
    raw = spark.read.schema(marked).option("columnNameOfCorruptRecord", "_malformed").json(path)
    # Spark parses for a filter on the marked column alone only if other columns are read with it.
    bad = raw.select("*", F.input_file_name().alias("_file")).where(F.col("_malformed").isNotNull() & (F.trim("_malformed") != "")).orderBy("_file").limit(1).collect()
    if bad:
        lines = spark.read.text(bad[0]["_file"]).toLocalIterator()
        at = next((k for k, r in enumerate(lines, 1) if r[0] == bad[0]["_malformed"]), 0)
        raise ValueError(f"{bad[0]['_file']}:{at}: malformed JSON")
    return spark.read.schema(schema).json(path)


def stream_json(spark: SparkSession, folder: str, schema: StructType, max_files: int = 100) -> DataFrame:
    """New files of JSON lines of a folder, at most max_files a batch; malformed lines stop the stream."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", max_files).json(folder)


def stream_files(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """New files of a folder tree as path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that is there, batch by batch, and stop. The checkpoint makes it resumable: a run
    that was stopped goes on with the first unfinished batch. step must be idempotent per batch id."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """A step that writes each batch to its own folder, so a repeated batch replaces itself."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return step


def derive_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """A step that derives the search units of each batch of evidence. A document's evidence must come in one
    batch, as it does where a file holds whole documents; a repeated batch replaces itself."""
    from ..operators.derive import search_units

    def step(batch: DataFrame, batch_id: int) -> None:
        search_units(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return step


def upsert(answered: DataFrame, new: DataFrame) -> DataFrame:
    """Answers (query_id, signature, answer, at): of each question and signature the latest one."""
    both = answered.unionByName(new)
    kept = both.groupBy("query_id", "signature").agg(F.max_by(F.struct("answer", "at"), F.col("at")).alias("r"))
    return kept.select("query_id", "signature", "r.answer", "r.at")


def unanswered(questions: DataFrame, answered: DataFrame, signature: str) -> DataFrame:
    """Questions (query_id, ...) without an answer under this run's signature."""
    done = answered.where(F.col("signature") == signature).select("query_id").distinct()
    return questions.join(done, "query_id", "left_anti")


def signature(**parts: str | int) -> str:
    """The signature of a run: a hash over everything that decides its answers."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(parts, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type and window of time; on a stream, rows later than late are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n_events", "total")
