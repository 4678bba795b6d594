"""References to records that do not exist (problem 4).

Parent and child keys are brought into one long form, tagged, and grouped by parent table and key; a
group without a live parent is an orphan key. The grouping combines on the map side, so a key that a
third of all references name costs one row per task. The orphan keys then meet the references again,
hot keys apart from the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from .joins import HOT_ROWS, hot_join

REFERENCE = ["parent_table", "ref_id", "table_name", "record_id", "ref_field", "period"]
#: Orphan keys up to this number and size in bytes are broadcast.
BROADCAST_KEYS, BROADCAST_BYTES = 200_000, 20_000_000


def month_of(stamp: Column) -> Column:
    """Month (yyyy-MM, UTC) of an ISO time string with any offset; null where it is null or malformed."""
    iso = F.when(stamp.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), stamp)
    return F.date_format(F.to_utc_timestamp(F.try_to_timestamp(iso), F.current_timezone()), "yyyy-MM")


def orphan_keys(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Keys (parent_table, ref_id) that some reference names and no live parent has.

    references: columns REFERENCE; parents: parent_table, ref_id, alive (boolean). Null keys are no
    references. A parent counts as live if any of its rows is.
    """
    child = references.where(F.col("ref_id").isNotNull()).select("parent_table", "ref_id", F.lit(1).alias("child"), F.lit(0).alias("live"))
    parent = parents.where(F.col("ref_id").isNotNull()).select("parent_table", "ref_id", F.lit(0).alias("child"), F.col("alive").cast("int").alias("live"))
    flags = child.unionByName(parent).groupBy("parent_table", "ref_id").agg(F.max("child").alias("child"), F.max("live").alias("live"))
    return flags.where((F.col("child") == 1) & (F.col("live") == 0)).select("parent_table", "ref_id")


def orphans(references: DataFrame, parents: DataFrame, broadcast_keys: int = BROADCAST_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each distinct reference to a key without a live parent: columns REFERENCE.

    Defined results: a null reference is none, the empty string is one; keys compare exactly; repeated
    rows count once, with their earliest period; a reference whose table is unknown (parent_table null) is an orphan; empty inputs
    give no rows. Orphan keys up to broadcast_keys are broadcast, more of them take a join that splits
    hot keys.
    """
    references = references.select(*REFERENCE).where(F.col("ref_id").isNotNull()).withColumn("parent_table", F.coalesce("parent_table", F.lit("")))
    parents = parents.where(F.col("parent_table").isNotNull())
    keys = cut(orphan_keys(references, parents))
    on = ["parent_table", "ref_id"]
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("ref_id") + F.octet_length("parent_table")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= broadcast_keys and size["bytes"] <= BROADCAST_BYTES:
        bad = references.join(F.broadcast(keys), on)
    else:
        bad = hot_join(references, keys, on, hot_rows=hot_rows)
    # Of several times of one reference the earliest counts.
    return bad.groupBy("table_name", "record_id", "ref_field", "ref_id", "parent_table").agg(F.min("period").alias("period")).select(*REFERENCE)


def record_references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The references of evidence, relations and search units in long form, and their possible targets."""
    evidence = table(spark, folder, "evidence").select("evidence_id", "document_id", "deleted_at", F.col("provenance.extracted_at").alias("at"))
    relation = table(spark, folder, "relation").select("relation_id", "from_ref", "to_ref", F.col("provenance.generated_at").alias("at"))
    units = table(spark, folder, "search_units").select("search_unit_id", "source_evidence_ids", F.col("provenance.generated_at").alias("at"))
    documents = table(spark, folder, "source_documents").select("document_id", "deleted_at")

    def shape(df: DataFrame, target: Column, ref: str, name: str, record: str, field: Column) -> DataFrame:
        return df.select(target.alias("parent_table"), F.col(ref).alias("ref_id"), F.lit(name).alias("table_name"), F.col(record).alias("record_id"), field.alias("ref_field"), month_of(F.col("at")).alias("period"))

    ends = relation.select("relation_id", "at", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.record_type").alias("kind"), F.col(f"{f}.record_id").alias("key")) for f in ("from_ref", "to_ref")])).alias("end")).select("relation_id", "at", "end.*").where(F.col("key").isNotNull())
    kind = F.when(F.col("kind") == "document", "source_documents").when(F.col("kind") == "evidence", "evidence")
    sources = units.select("search_unit_id", "at", F.explode("source_evidence_ids").alias("key"))
    parts = [
        shape(evidence.where(F.col("document_id").isNotNull()), F.lit("source_documents"), "document_id", "evidence", "evidence_id", F.lit("document_id")),
        shape(ends, kind, "key", "relation", "relation_id", F.col("field")),
        shape(sources.where(F.col("key").isNotNull()), F.lit("evidence"), "key", "search_units", "search_unit_id", F.lit("source_evidence_ids")),
    ]
    targets = [
        documents.select(F.lit("source_documents").alias("parent_table"), F.col("document_id").alias("ref_id"), F.col("deleted_at").isNull().alias("alive")),
        evidence.select(F.lit("evidence").alias("parent_table"), F.col("evidence_id").alias("ref_id"), F.col("deleted_at").isNull().alias("alive")),
    ]
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, targets)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans(*record_references(spark, folder)).select("table_name", "record_id", "ref_field", "ref_id").distinct()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, field and month; the month is 'unknown' where the time is null or malformed."""
    bad = orphans(*record_references(spark, folder))
    return bad.groupBy("table_name", "ref_field", F.coalesce("period", F.lit("unknown")).alias("month")).agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("ref_id").alias("n_keys"))
