"""Sinks: record tables, manifests, ledgers, predictions, run logs and reports."""

from __future__ import annotations

import csv
import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The order of statuses in the coverage ledger.
STATUS_ORDER = ["failed", "deferred", "partial", "extracted"]


def refuse_inside(path: str, source_root: str) -> None:
    """Raise if path is the source root or lies below it: an output there would become input."""
    inner, outer = ([p for p in x.removeprefix("file:").split("/") if p not in ("", ".")] for x in (path, source_root))
    if inner[: len(outer)] == outer:
        raise ValueError(f"the output {path} lies inside the source {source_root}")


def shard_facts(df: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, record_count, size_bytes, checksum) of each document's records as JSON lines. The checksum doesn't
    depend on their order, so it is combined on the map side, whatever a document holds."""
    line = F.to_json(F.struct(*sorted(df.columns)))
    return df.select(key, line.alias("line")).groupBy(key).agg(F.count(F.lit(1)).alias("record_count"), F.sum(F.octet_length("line") + 1).alias("size_bytes"), F.bit_xor(F.xxhash64("line")).alias("checksum"))


def corrupt_shards(df: DataFrame, facts: DataFrame, key: str = "document_id") -> DataFrame:
    """Keys whose records are missing or differ from the facts that were written for them."""
    now = shard_facts(df, key)
    return facts.join(now, [key, "record_count", "size_bytes", "checksum"], "left_anti").select(key)


class BuildLock:
    """with BuildLock(spark, path): one build at a time per output, by a file that only one can create.

    A build that died leaves the file; remove() takes it away."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.lock")
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def __enter__(self) -> BuildLock:
        if not self.files.createNewFile(self.path):
            raise RuntimeError(f"another build is using this output: {self.path}")
        return self

    def __exit__(self, *_) -> None:
        self.remove()

    def remove(self) -> None:
        self.files.delete(self.path, False)


def write_records(df: DataFrame, path: str, key: str = "document_id", source_root: str | None = None) -> None:
    """Records as JSON lines in one folder per document; refuses a path that holds something already, or that
    lies inside source_root."""
    if source_root is not None:
        refuse_inside(path, source_root)
    df.write.mode("errorifexists").partitionBy(key).json(path)


def write_sorted(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in total order over the files, by a range partitioning."""
    df.orderBy(*order).write.mode("errorifexists").json(path)


def write_index(postings: DataFrame, terms: DataFrame, documents: DataFrame, path: str) -> None:
    """An index as three parquet tables; postings sorted by term, so that a search reads few row groups."""
    postings.repartitionByRange("term", "unit_seq").sortWithinPartitions("term", "unit_seq").write.mode("errorifexists").parquet(f"{path}/postings")
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("errorifexists").parquet(f"{path}/terms")
    documents.write.mode("errorifexists").parquet(f"{path}/documents")


def write_manifest(df: DataFrame, path: str, **facts: str | int) -> None:
    """One row about a written table: its row count, an order-free checksum of its rows, and the given facts."""
    size = df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("checksum"))
    for name, value in facts.items():
        size = size.withColumn(name, F.lit(value))
    size.coalesce(1).write.mode("errorifexists").json(path)


def write_build_state(df: DataFrame, path: str, source_state: str, **facts: str | int) -> None:
    """A manifest that names the state it was built from by the hash of its bytes, which chains the builds."""
    raw = df.sparkSession.read.format("binaryFile").load(source_state)
    links = raw.orderBy("path").agg(F.sha2(F.to_binary(F.array_join(F.collect_list(F.sha2("content", 256)), ""), F.lit("utf-8")), 256).alias("h")).first()["h"]
    write_manifest(df, path, source_state_sha256=links, build_status="complete", **facts)


def chain_breaks(df: DataFrame, path: str, source_state: str) -> list[str]:
    """What no longer agrees: the table with its manifest, or the manifest with the state it was built from."""
    spark = df.sparkSession
    manifest = spark.read.json(path)
    raw = spark.read.format("binaryFile").load(source_state)
    links = raw.orderBy("path").agg(F.sha2(F.to_binary(F.array_join(F.collect_list(F.sha2("content", 256)), ""), F.lit("utf-8")), 256).alias("h")).first()["h"]
    row = manifest.first()
    checks = {"table differs from its manifest": not matches_manifest(df, manifest), "source state has changed": row["source_state_sha256"] != links, "build isn't complete": row["build_status"] != "complete"}
    return [name for name, broken in checks.items() if broken]


def matches_manifest(df: DataFrame, manifest: DataFrame) -> bool:
    """Whether a table has the rows its manifest was written for."""
    want = manifest.select("n_rows", "checksum").first()
    have = df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("checksum")).first()
    return (want["n_rows"], want["checksum"]) == (have["n_rows"], have["checksum"])


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file through the file system of its path."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def coverage_ledger(coverage: DataFrame) -> DataFrame:
    """Coverage rows (path, status, detail) in the ledger's order: worst status first, then by path."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status")), F.lit(0)), F.lit(99))
    return coverage.withColumn("rank", rank).orderBy("rank", "path").drop("rank")


def write_coverage(coverage: DataFrame, path: str, max_lines: int = 10_000) -> None:
    """The ledger as Markdown: counts by status, then up to max_lines rows and how many are left out; the table
    itself stays complete."""
    counts = coverage.groupBy("status").count().collect()
    lines = ["# Coverage", "", *[f"- {r['status']}: {r['count']}" for r in sorted(counts, key=lambda r: str(r["status"]))], "", "| path | status | detail |", "|-|-|-|"]
    lines += [f"| {r['path']} | {r['status']} | {r['detail'] or ''} |" for r in coverage_ledger(coverage).limit(max_lines).collect()]
    rest = sum(r["count"] for r in counts) - max_lines
    lines += [f"| … | {rest} more rows | |"] * (rest > 0)
    _put(coverage.sparkSession, path, "\n".join(lines).encode())


def write_predictions(predictions: DataFrame, path: str, archive: bool = False) -> None:
    """Predictions (position, index, answer) as headerless CSV, or that in a ZIP as predictions.csv."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for row in predictions.orderBy("position").select("index", "answer").toLocalIterator():
        writer.writerow([row["index"], (row["answer"] or "").replace("\r\n", " ").replace("\n", " ")])
    data = out.getvalue().encode()
    if archive:
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("predictions.csv", data)
        data = packed.getvalue()
    _put(predictions.sparkSession, path, data)


def append_run_log(spark: SparkSession, path: str, **facts) -> None:
    """One row about a run at the end of the log table."""
    row = spark.createDataFrame([(json.dumps(facts, ensure_ascii=False, sort_keys=True),)], "run string").withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").json(path)


def report(diagnosed: DataFrame, path: str, shown: int = 200, clip: int = 1_600) -> None:
    """A diagnosis as Markdown: the first questions with their answers, clipped."""
    lines = ["# Diagnosis", ""]
    for r in diagnosed.orderBy("query_id").limit(shown).collect():
        lines += [f"## {r['query_id']}: {r['category']}", f"- expected: {(r['expected'] or '')[:clip]}", f"- answer: {(r['predicted'] or '')[:clip]}", ""]
    _put(diagnosed.sparkSession, path, "\n".join(lines).encode())
