import json

from pyspark.sql import functions as F

from shiori.operators import answers, charts, mining, providers, quality
from shiori.streaming import incremental


def found(df):
    return {(r["check"], r["record_id"]) for r in df.collect()}


def test_chart_table_ignores_what_is_no_number(spark):
    df = spark.createDataFrame([("1", 2.0), ("1", None), ("1.0", 4.0), ("x", 9.0), (None, 1.0), ("2", None), ("nan", 1.0)], "x string, y double")
    got = {r["x"]: (r["n_rows"], r["mean"]) for r in charts.group_table(df, "x", "y").collect()}
    assert got == {1.0: (3, 3.0), 2.0: (1, None)}
    assert {r["x"]: r["status"] for r in charts.points(charts.group_table(df, "x", "y"), "mean").collect()} == {1.0: "exact", 2.0: "unresolved"}
    assert df.agg(charts.is_day_number("x")).first()[0] in (True, False) and charts.group_table(df.limit(0), "x", "y").count() == 0


def test_chart_assembly(spark):
    long = spark.createDataFrame([("c", "s", 2.0, 1.0), ("c", "s", 1.0, 3.0), ("c", "t", 1.0, 3.0)], "chart_id string, series_id string, x double, y double")
    row = charts.assemble(long).first()
    assert row["x_values"] == [1.0, 2.0] and row["completeness"] == "partial" and [p["x"] for p in row["series"][0]["points"]] == [1.0, 2.0]


def test_colours(spark):
    red, blue, grey = (200, 20, 20), (20, 20, 220), (120, 120, 120)
    pixels = [("i", *c) for c, n in ((red, 60), (blue, 40), (grey, 500), ((210, 60, 20), 30), ((20, 200, 20), 10)) for _ in range(n)]
    df = spark.createDataFrame(pixels, "image string, r int, g int, b int")
    clusters = charts.colour_clusters(charts.colour_bins(df, ["image"]), "image")
    assert [r["weight"] for r in clusters.orderBy("cluster_no").collect()] == [90, 40]
    views = charts.isolated(df, clusters, "image").groupBy("cluster_no").count().collect()
    assert {r["cluster_no"] for r in views} == {0, 1}
    assert charts.merge_hues([], 1, 6, 0.3) == []


def test_mined_code(spark):
    source = "df = pd.read_csv('data/a.csv')\nt = df.groupby('day').agg(n=('price', 'size'))\nt.plot()\nplt.savefig(OUT / 'fig/one.png')"
    cells = spark.createDataFrame([("n.ipynb", "cell-0", source), ("n.ipynb", "cell-1", "plt.savefig('two.jpg')")], "path string, location string, source string")
    first = charts.mined(cells).where("location = 'cell-0'").first()
    assert (first["group_x"], first["group_y"], first["group_label"]) == ("'day'", "'price'", "n") and first["data"] == ["data/a.csv"] and "plot" in first["plots"] and first["has_groupby"]
    files = spark.createDataFrame([("x/fig/one.png",), ("y/one.png",)], "path string")
    got = {r["image"]: r for r in charts.source_candidates(cells, files).collect()}
    assert got["fig/one.png"]["image_paths"] == ["x/fig/one.png", "y/one.png"] and got["two.jpg"]["image_paths"] is None and got["two.jpg"]["data"] == ["data/a.csv"]


def test_diagnosis(spark):
    asked = spark.createDataFrame([(1, "ABC"), (2, "台座の数"), (3, "xyz"), (4, "nowhere"), (5, "")], "query_id int, expected string")
    given = spark.createDataFrame([(1, " ＡＢＣ"), (2, "no"), (3, "no"), (4, "no")], "query_id int, predicted string")
    chunks = spark.createDataFrame([(10, "the 台座の数 is"), (11, "xyz here"), (12, None)], "cid int, text string")
    hits = spark.createDataFrame([(2, 10), (3, 10)], "query_id int, cid int")
    got = {r["query_id"]: r["category"] for r in answers.diagnose(asked, given, chunks, hits).collect()}
    assert got == {1: answers.SUCCESS, 2: answers.GENERATION, 3: answers.RETRIEVAL, 4: answers.REVIEW, 5: answers.REVIEW}
    reviews = spark.createDataFrame([(4, "done"), (3, " ")], "query_id int, final string")
    got = {r["query_id"]: r["category"] for r in answers.diagnose(asked, given, chunks, hits, reviews).collect()}
    assert got[4] == "done" and got[3] == answers.RETRIEVAL


def test_submission(spark):
    want = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "position int, index int")
    good = spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (2, 3, "c")], "position int, index int, answer string")
    assert answers.submission(want, good).count() == 0
    bad = spark.createDataFrame([(0, 2, "a"), (1, 1, " "), (2, 2, "あ" * 400), (3, 9, None)], "position int, index int, answer string")
    got = {(r["position"], r["check"]) for r in answers.submission(want, bad).collect()}
    assert got == {(0, "order differs"), (1, "order differs"), (2, "order differs"), (3, "order differs"), (0, "index repeated"), (2, "index repeated"), (1, "answer empty"), (3, "answer empty"), (2, "answer too long")}


def test_index_validator(spark):
    terms = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (3, "c", None), (4, "a", 0)], "term_id long, term string, document_frequency long")
    postings = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, 9, 1), (2, 9, 1), (7, 1, 1)], "term_id long, doc_rowid long, term_frequency long")
    units = spark.createDataFrame([(1,)], "unit_seq long")
    got = found(quality.lexical_index(terms, postings, units))
    assert {("document frequency wrong", "2"), ("document frequency wrong", "3"), ("posting of a missing unit", "2"), ("posting repeated", "2"), ("frequency not positive", "2"), ("term of a posting missing", "7"), ("term repeated", "1")} == got


def test_vector_validator(spark):
    rows = [(1, "u", "m", [1.0, 0.0]), (2, "u", "m", [0.9, 0.0]), (3, "u", "x", [1.0]), (4, "z", "m", None), (5, "u", "m", [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "row_no long, search_unit_id string, model string, matrix array<double>")
    got = found(quality.semantic_index(df, spark.createDataFrame([("u",)], "search_unit_id string"), "m", 2))
    assert got == {("length not one", "2"), ("other model", "3"), ("dimensions wrong", "3"), ("unit missing", "4"), ("vector missing", "4"), ("not finite", "5")}


def test_chart_and_visual_validators(spark):
    long = spark.createDataFrame([("c", "s", 1.0, 1.0, "exact"), ("c", "s", 2.0, None, "exact"), ("c", "t", 1.0, 2.0, "unresolved")], "chart_id string, series_id string, x double, y double, status string")
    assert {c for c, _ in found(quality.chart_tables(long))} == {"points missing", "unresolved with a value", "exact without a value"}
    images = spark.createDataFrame([("p", b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (2).to_bytes(4, "big"))], "path string, content binary")
    done = providers.analyse_images(images, providers.SizeVision())
    assert json.loads(done.first()["fusion"]) == {"stage": "fusion", "size": [3, 2], "n_upstream": 2}
    checked = done.withColumnRenamed("path", "analysis_id")
    assert quality.visual_analyses(checked).count() == 0
    assert quality.visual_analyses(checked.withColumn("retry_count", F.lit(3)).withColumn("fusion", F.lit(None).cast("string"))).count() == 3


def test_mining(spark):
    df = spark.createDataFrame([("会議 2024-5-1 と 2024年12月03、2024-5-1",), (None,)], "t string")
    assert [r[0] for r in df.select(mining.dates_in(F.col("t"))).collect()] == [["20240501", "20241203"], None]
    files = spark.createDataFrame([("a/pw_secret1.XLSX", ["hk"], ["20240501"]), ("b/x.pdf", None, None)], "path string, aliases array<string>, dates array<string>")
    assert [(r["path"], r["candidate"]) for r in mining.password_candidates(files).orderBy("path", "ord").collect()] == [("a/pw_secret1.XLSX", "secret1"), ("a/pw_secret1.XLSX", "DA-hk-20240501-xlsx"), ("a/pw_secret1.XLSX", "DA-HK-20240501-xlsx")]
    paths = spark.createDataFrame([("x/プロジェクト/北斗/a",), ("x/a",)], "p string")
    assert [r[0] for r in paths.select(mining.project_of(F.col("p"))).collect()] == ["北斗", None]
    projects, names = spark.createDataFrame([("北斗",), ("海霧検証",)], "project string"), spark.createDataFrame([("HK", "北斗更新"), ("KM", "海霧")], "alias string, canonical string")
    assert {(r["project"], r["alias"]) for r in mining.aliases_of_projects(projects, names).collect()} == {("北斗", "HK"), ("海霧検証", "KM")}


def test_providers(spark):
    units = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "unit_seq long, search_text string")
    vectors = {r["unit_seq"]: r["vector"] for r in providers.embed(units, providers.HashEmbedder(8)).collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in vectors.values()) and vectors[2] == vectors[3]
    asked = spark.createDataFrame([(1, "台座の数は", "--- [x]\n台座の数は 12\nother"), (2, "zzz", "台座")], "query_id int, query string, context string")
    assert {r["query_id"]: r["answer"] for r in providers.answer(asked, providers.ExtractiveAnswers()).collect()} == {1: "台座の数は 12", 2: providers.ABSTAIN}
    assert providers.model_json("```json\n{\"a\": 1}\n```") == {"a": 1}


def test_incremental(spark):
    listing = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("c", "3")], "path string, sha256 string")
    manifest = spark.createDataFrame([("a", "1", "success"), ("b", "old", "success"), ("c", "3", "failed")], "path string, sha256 string, status string")
    assert sorted(r["path"] for r in incremental.pending(listing, manifest).collect()) == ["b", "c"]
    assert incremental.build_status(manifest, listing) == "in_progress"
    assert incremental.build_status(manifest, listing.where("path != 'b'")) == "complete_with_failures"
    assert incremental.build_status(manifest.where("path = 'a'"), listing.where("path = 'a'")) == "complete"


def test_stream_resumes(spark, tmp_path):
    source, out, log = tmp_path / "in", tmp_path / "out", tmp_path / "log"
    source.mkdir()
    schema = spark.createDataFrame([], "id long, text string").schema
    write = lambda name, *ids: (source / name).write_text("".join(json.dumps({"id": i, "text": "x"}) + "\n" for i in ids))
    write("a.json", 1, 2)
    step = incremental.append_batch(str(out))
    incremental.run_available(incremental.stream_json(spark, str(source), schema), step, str(log))
    write("b.json", 3)
    incremental.run_available(incremental.stream_json(spark, str(source), schema), step, str(log))
    incremental.run_available(incremental.stream_json(spark, str(source), schema), step, str(log))
    assert sorted(r["id"] for r in spark.read.parquet(str(out)).collect()) == [1, 2, 3]


def test_event_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["n_events"], r["total"]) for r in incremental.event_windows(df).collect()) == [(1, 4.0), (2, 3.0)]
