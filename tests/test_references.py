from shiori.operators.references import REFERENCE, month_of, orphan_keys, orphans
from pyspark.sql import functions as F

SCHEMA = "parent_table string, ref_id string, table_name string, record_id string, ref_field string, period string"


def tables(spark):
    refs = [("e", "a", "rel", "r1", "from", "2025-01"), ("e", "a", "rel", "r1", "from", "2025-01"), ("e", "gone", "rel", "r2", "to", None), ("e", "dead", "rel", "r3", "to", "2025-02"), ("e", None, "rel", "r4", "to", "2025-02"), ("e", "", "rel", "r5", "to", "2025-02"), (None, "a", "rel", "r6", "to", "2025-02"), ("d", "a", "rel", "r7", "to", "2025-03")]
    refs += [("e", "hot", "ev", f"h{k}", "doc", "2025-01") for k in range(60)]
    parents = [("e", "a", True), ("e", "dead", False), ("e", "a", True), ("e", None, True), ("d", "b", True)]
    return spark.createDataFrame(refs, SCHEMA), spark.createDataFrame(parents, "parent_table string, ref_id string, alive boolean")


def test_orphans(spark):
    refs, parents = tables(spark)
    want = sorted([("r2", "gone"), ("r3", "dead"), ("r5", ""), ("r6", "a"), ("r7", "a")] + [(f"h{k}", "hot") for k in range(60)])
    for limit, hot in ((1_000, 10_000), (0, 20)):
        found = orphans(refs, parents, broadcast_keys=limit, hot_rows=hot)
        assert sorted((r["record_id"], r["ref_id"]) for r in found.collect()) == want
        assert found.columns == REFERENCE


def test_extra_columns_and_empty_tables(spark):
    refs, parents = tables(spark)
    assert orphans(refs.withColumn("alive", F.lit(1)), parents.withColumn("record_id", F.lit("x"))).count() == 65
    assert orphans(refs.limit(0), parents).count() == 0
    assert orphans(refs, parents.limit(0)).count() == 66
    assert orphan_keys(refs.limit(0), parents.limit(0)).count() == 0


def test_months(spark):
    stamps = ["2026-01-31T23:30:00-01:00", "2026-02-01T00:30:00+09:00", "2026-05-25T23:34:41.000000+00:00", "2026-03-01T00:00:00Z", "2026/03/01 00:00", None, ""]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(stamps)], "k int, s string")
    assert [r[0] for r in df.orderBy("k").select(month_of(F.col("s"))).collect()] == ["2026-02", "2026-01", "2026-05", "2026-03", None, None, None]
