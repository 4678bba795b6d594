import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shiori.operators import charts, glossary, quality
from shiori.sources import sinks
from shiori.streaming import incremental

CODE = """data_path = Path('data/a.csv')
target_col = "score"
date_col_hint = 'day'
agg = tmp.groupby(used_col).agg(件数=(target_col, 'size'))
agg['平均'] = tmp.groupby(used_col)[target_col].mean()
ax.plot(agg.index, agg['件数'], marker='o', color="red")
ax2.plot(agg.index, agg['平均'])
ax.set_title(f'{used_col}別')
"""


def test_charts_are_read_from_code(spark):
    cells = spark.createDataFrame([("n", "1", CODE), ("m", "1", CODE), ("m", "2", CODE), ("k", "1", "x = 1"), ("k", "2", None)], "path string, location string, source string")
    row = charts.chart_code(cells).collect()
    assert len(row) == 1 and row[0]["path"] == "n"
    got = row[0].asDict(recursive=True)
    assert (got["x"], got["target"], got["count_label"], got["mean_label"], got["title"], got["data"]) == ("day", "score", "件数", "平均", "day別", ["data/a.csv"])
    assert got["styles"] == [{"label": "件数", "marker": "o", "colour": "red"}, {"label": "平均", "marker": None, "colour": None}]


def chart(spark):
    long = spark.createDataFrame([("c", "count", 1.0, 4.0), ("c", "count", 2.5, 5.0), ("c", "mean", 1.0, 0.5), ("c", "mean", 2.5, None)], "chart_id string, series_id string, x double, y double")
    sources = spark.createDataFrame([("c", "a.png", "a" * 64, "n.ipynb", "b" * 64, "a.csv", "c" * 64, "day", "title")], "chart_id string, chart_path string, chart_sha256 string, code_path string, code_sha256 string, data_path string, data_sha256 string, x_label string, title string")
    return charts.chart_records(charts.assemble(long), sources)


def test_chart_records(spark):
    row = chart(spark).first()
    assert row["chart_table_id"].startswith("ct_") and row["x_values"] == ["1", "2.5"] and row["chart_type"] == "multi_axis_line" and row["status"] == "verified"
    assert [s["axis_id"] for s in row["series"]] == ["y_left", "y_right"] and row["series"][1]["points"][1]["status"] == "unresolved"
    assert quality.chart_records(chart(spark)).count() == 0


@pytest.mark.parametrize("column, value, check", [
    ("chart_table_id", "'ct_1'", "chart id malformed"), ("x_values", "array('1')", "points missing"), ("detected_series_count", "3L", "series count wrong"), ("axes", "slice(axes, 1, 2)", "series on an unknown axis"),
    ("axes", "slice(axes, 2, 2)", "axis missing or repeated"), ("provenance", "named_struct('chart_sha256', 'x', 'code_sha256', 'x', 'data_sha256', 'x')", "provenance hash malformed"),
    ("series", "transform(series, s -> named_struct('series_id', s.series_id, 'axis_id', s.axis_id, 'points', transform(s.points, p -> named_struct('x', p.x, 'y', 1D, 'status', 'unresolved'))))", "unresolved with a value"),
])
def test_corrupt_charts(spark, column, value, check):
    bad = chart(spark).withColumn(column, F.expr(value))
    assert check in {r["check"] for r in quality.chart_records(bad).collect()}


def test_glossaries_are_told_by_their_heads(spark):
    rows = [("t", 1, ["No", "主略称", "正式名称", "別名候補"]), ("t", 2, ["1", "HK、北", "北斗更新", "ほくと"]), ("t", 3, ["2"]), ("u", 1, ["a", "b"]), ("u", 2, ["x", "y"]), ("v", 1, ["略称", "正式名称"])]
    tables = spark.createDataFrame(rows, "table_id string, row_no int, cells array<string>")
    pairs = glossary.pairs_of_tables(tables)
    assert [(r["alias"], r["canonical"]) for r in pairs.orderBy("ord").collect()] == [("HK、北", "北斗更新"), ("ほくと", "北斗更新")]
    assert {r["alias"] for r in glossary.build(pairs).collect()} == {"HK", "ほくと"}


def test_shards_that_changed_are_done_again(spark):
    rows = spark.createDataFrame([("d1", "a", 1), ("d1", "b", 2), ("d2", "c", 3)], "document_id string, t string, n int")
    facts = sinks.shard_facts(rows)
    assert {r["document_id"]: r["record_count"] for r in facts.collect()} == {"d1": 2, "d2": 1}
    changed = rows.withColumn("n", F.when(F.col("t") == "b", 9).otherwise(F.col("n")))
    corrupt = sinks.corrupt_shards(changed, facts)
    assert [r[0] for r in corrupt.collect()] == ["d1"]
    listing = spark.createDataFrame([("p1", "1"), ("p2", "2"), ("p3", "3")], "path string, sha256 string")
    manifest = spark.createDataFrame([("p1", "1", "success", "d1", "r", "v1"), ("p2", "2", "success", "d2", "r", "v1"), ("p3", "3", "success", "d3", "r", "v0")], "path string, sha256 string, status string, document_id string, source_root string, extractor_version string")
    got = lambda **o: sorted(r["path"] for r in incremental.pending(listing, manifest, **o).collect())
    assert got() == [] and got(corrupt=corrupt) == ["p1"] and got(version="v1") == ["p3"] and got(root="s") == ["p1", "p2", "p3"]


def test_one_build_at_a_time(spark, tmp_path):
    path = str(tmp_path / "out")
    with sinks.BuildLock(spark, path):
        with pytest.raises(RuntimeError, match="another build"):
            sinks.BuildLock(spark, path).__enter__()
    with sinks.BuildLock(spark, path):
        pass
    with pytest.raises(ValueError):
        sinks.refuse_inside("/share/root/out", "/share/root")
    sinks.refuse_inside("/share/root2", "/share/root")


def test_states_are_chained(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    sinks.write_manifest(df, str(tmp_path / "one"))
    sinks.write_build_state(df, str(tmp_path / "two"), str(tmp_path / "one"))
    assert sinks.chain_breaks(df, str(tmp_path / "two"), str(tmp_path / "one")) == []
    assert sinks.chain_breaks(df.limit(1), str(tmp_path / "two"), str(tmp_path / "one")) == ["table differs from its manifest"]
    df.limit(1).write.mode("overwrite").json(str(tmp_path / "one"))
    assert sinks.chain_breaks(df, str(tmp_path / "two"), str(tmp_path / "one")) == ["source state has changed"]


def test_build_states(spark):
    incremental.require_complete("complete")
    incremental.require_complete("complete_with_failures", allow_failures=True)
    for status in ("in_progress", "complete_with_failures"):
        with pytest.raises(RuntimeError):
            incremental.require_complete(status)
    manifest = spark.createDataFrame([("a", "success", None), ("b", "failed", "no zip")], "path string, status string, error string")
    with pytest.raises(RuntimeError, match="b: no zip"):
        incremental.fail_fast(manifest)
    incremental.fail_fast(manifest.where("path = 'a'"))


def test_malformed_lines_are_named(spark, tmp_path):
    schema = StructType([StructField("a", LongType()), StructField("b", StringType())])
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    assert incremental.read_json_lines(spark, str(tmp_path / "good"), schema).count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2\n')
    with pytest.raises(ValueError, match="x.jsonl:3"):
        incremental.read_json_lines(spark, str(tmp_path / "bad"), schema)


def test_latest_answers_stay(spark):
    schema = "query_id int, signature string, answer string, at int"
    old, new = spark.createDataFrame([(1, "s", "a", 1), (2, "s", "b", 1)], schema), spark.createDataFrame([(1, "s", "c", 2), (1, "t", "d", 2)], schema)
    assert {(r["query_id"], r["signature"]): r["answer"] for r in incremental.upsert(old, new).collect()} == {(1, "s"): "c", (2, "s"): "b", (1, "t"): "d"}


def test_units_of_a_stream_are_those_of_the_table(spark, tmp_path):
    from shiori.operators import derive

    schema = "evidence_id string, document_id string, evidence_type string, seq long, raw_text string, raw_value string, page_number int, slide_number int, sheet_name string, cell string, paragraph_index int, table_index int, row_index int, column_index int, shape_id string"
    row = lambda d, k: (f"ev_{d}{k}", d, "paragraph", k, f"text {d} {k}", None, None, None, None, None, k, None, None, None, None)
    for d in ("d1", "d2"):
        spark.createDataFrame([row(d, k) for k in range(5)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = incremental.stream_json(spark, str(tmp_path / "in"), spark.read.json(str(tmp_path / "in"), schema=schema).schema, max_files=1)
    incremental.run_available(stream, incremental.derive_batch(str(tmp_path / "out")), str(tmp_path / "check"))
    want = {r["search_unit_id"] for r in derive.search_units(spark.read.schema(schema).json(str(tmp_path / "in"))).collect()}
    assert {r["search_unit_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want and len(want) == 2
