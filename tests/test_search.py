import math

import pytest
from pyspark.sql import functions as F

from shiori.operators import evaluation, fusion, glossary, index, legacy, lexical, semantic

UNITS = "unit_seq long, search_unit_id string, document_id string, unit_type string, search_text string, source_evidence_ids array<string>"


@pytest.fixture(scope="module")
def micro(spark):
    rows = [(1, "u1", "d", "page_text", "apple apple pear", ["a"]), (2, "u2", "d", "page_text", "pear fig", ["b"]), (3, "u3", "d", "page_text", "", ["c"]), (4, "u4", "d", "page_text", None, ["d"])]
    return index.build(spark.createDataFrame(rows, UNITS))


def queries(spark, *texts):
    return spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query_id string, query string")


def test_bm25_of_the_micro_corpus(spark, micro):
    hits = {r["unit_seq"]: r["lexical_score"] for r in lexical.search_bm25(micro, queries(spark, "apple pear")).collect()}
    assert hits == {1: pytest.approx(1.0708543050, abs=1e-9), 2: pytest.approx(0.1985680322, abs=1e-9)}
    assert micro.n_documents == 2 and micro.average_length == 2.5 and micro.documents.count() == 4


def test_queries_without_terms(spark, micro):
    assert lexical.search_bm25(micro, queries(spark, "", None, "。")).count() == 0
    with pytest.raises(ValueError):
        lexical.search(micro, queries(spark, "apple"), top_k=0)


def test_too_many_terms_fail(spark, micro):
    with pytest.raises(Exception, match="more than 500"):
        lexical.search_bm25(micro, queries(spark, " ".join(f"t{k}" for k in range(501)))).collect()


def test_rerank_prefers_named_values_and_children(spark):
    rows = [
        (1, "u1", "d", "table_row", "品名: 台座\n数量: 12", ["h"]),
        (2, "u2", "d", "table_row", "品名: 台座\n数量: 12\n状態: 完了", ["h", "x"]),
        (3, "u3", "e", "table_row", "品名: 別物\n数量: 台座台座", ["z"]),
    ]
    idx = index.build(spark.createDataFrame(rows, UNITS))
    hits = lexical.search(idx, queries(spark, "台座 12 完了")).orderBy("rank").collect()
    assert hits[0]["search_unit_id"] == "u2" and hits[0]["exact_field_value_matches"] == ["台座", "12", "完了"]
    assert {h["search_unit_id"]: h["parent_context_penalty"] for h in hits} == {"u1": 2.0, "u2": 0.0, "u3": 0.0}
    plain = lexical.search(idx, queries(spark, "台座 12 完了"), field_value_weight=0.0, parent_context_penalty=0.0).orderBy("rank").collect()
    bm25 = lexical.search_bm25(idx, queries(spark, "台座 12 完了")).orderBy("rank").collect()
    assert [h["unit_seq"] for h in plain] == [h["unit_seq"] for h in bm25]


def test_ties_go_to_the_smaller_unit(spark):
    rows = [(k, f"u{k}", "d", "page_text", "same words", ["a"]) for k in (5, 3, 9)]
    hits = lexical.search_bm25(index.build(spark.createDataFrame(rows, UNITS)), queries(spark, "words")).orderBy("rank").collect()
    assert [h["unit_seq"] for h in hits] == [3, 5, 9]


def test_legacy_bm25(spark):
    chunks = [(0, "x/a", None, "", "", "apple apple pear"), (1, "x/b", None, "", "", "pear fig")]
    df = spark.createDataFrame(chunks, "cid long, path string, project string, filename string, location string, text string").withColumn("path", F.lit("p"))
    asked = spark.createDataFrame([("q", "apple apple pear", [])], "query_id string, query string, names array<string>")
    got = {r["cid"]: r["score"] for r in legacy.search(df, asked).collect()}
    assert got == {0: pytest.approx(2.0280652835), 1: pytest.approx(0.2003533591)}


def test_legacy_boosts(spark):
    rows = [(0, "山吹研修/report_2024.docx", "山吹研修", "report_2024.docx", "", "budget text"), (1, "灯台移行/other.docx", "灯台移行", "other.docx", "", "budget text"), (2, "common.docx", None, "common.docx", "", "[画像ファイル] ※OCR/VLM未実施 budget text")]
    df = spark.createDataFrame(rows, "cid long, path string, project string, filename string, location string, text string")
    asked = spark.createDataFrame([("q", "山吹研修 report_2024 budget", [])], "query_id string, query string, names array<string>")
    got = {r["cid"]: r["score"] / r["base_score"] for r in legacy.search(df, asked).collect()}
    assert got == {0: pytest.approx(7.5), 1: pytest.approx(0.25), 2: pytest.approx(0.36)}
    hits = spark.createDataFrame([("q", 1, 0), ("q", 2, 1), ("q", 3, 2)], "query_id string, rank int, cid long")
    kept = legacy.context(hits, df, budget=60).orderBy("rank").collect()
    assert [r["cid"] for r in kept] == [0] and kept[0]["block"].startswith("--- [山吹研修/report_2024.docx]\n")


def test_cosine_blocks(spark, monkeypatch):
    monkeypatch.setattr(semantic, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(semantic, "QUERY_BLOCK", 3)
    vectors = [(k, [math.cos(k), math.sin(k), 0.1 * k]) for k in range(1, 30)] + [(30, None), (31, [0.0, 0.0, 0.0]), (32, [1.0]), (33, [float("nan"), 1.0, 1.0])]
    df = spark.createDataFrame(vectors, "unit_seq long, vector array<double>").withColumn("vector", F.col("vector").cast("array<float>"))
    asked = df.where("unit_seq in (3, 8, 20, 30, 31)").select(F.col("unit_seq").alias("query_id"), "vector")
    got = {(r["query_id"], r["rank"]): r["unit_seq"] for r in semantic.search(df, asked, 4, 3).collect()}

    def best(q):
        unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
        a = unit(dict(vectors)[q])
        return sorted(range(1, 30), key=lambda k: (-round(sum(x * y for x, y in zip(a, unit(dict(vectors)[k]))), 6), k))[:4]

    assert got == {(q, r + 1): u for q in (3, 8, 20) for r, u in enumerate(best(q))}


def test_fusion(spark):
    lex = spark.createDataFrame([("q", 1, 3.0, 2, 2, "a"), ("r", 1, 1.0, 1, 9, "b"), ("r", 2, 0.9, 1, 9, "c")], "query_id string, rank int, score double, matched_terms long, n_terms int, search_unit_id string")
    sem = spark.createDataFrame([("q", 2, "a"), ("q", 1, "z"), ("r", 1, "c"), ("s", 1, "y")], "query_id string, rank int, search_unit_id string")
    asked = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    got = {(r["query_id"], r["search_unit_id"]): (r["score"], r["semantic_weight"]) for r in fusion.hybrid(lex, sem, asked).collect()}
    assert got["q", "a"] == (pytest.approx(0.0204257007), 0.25)
    assert got["r", "c"][1] == 1.0 and got["s", "y"][1] == 1.0  # unsure, and without any lexical hit
    plain = fusion.hybrid(lex, sem.limit(0), asked, semantic_weight=0.0, adaptive=False).where("query_id = 'r'").orderBy("rank").collect()
    assert [r["search_unit_id"] for r in plain] == ["b", "c"]
    with pytest.raises(ValueError):
        fusion.hybrid(lex, sem, asked, low_margin=0)


def test_round_robin(spark):
    df = spark.createDataFrame([("page_text", 1), ("page_text", 2), ("table_row", 3)], "t string, n int")
    assert [r["n"] for r in evaluation.round_robin(df, "t", "n", 3).collect()] == [1, 3, 2]


def test_self_retrieval_case(spark):
    units = spark.createDataFrame([(1, "su_19b1ebddc42109865ccc09c62d13ab28", "d", "paragraph_chunk", "hello", ["e"]), (2, "u2", "d", "table_row", "セクション: x\n品名: 台座\n数量: 12", ["e"]), (3, "u3", "d", "page_text", " 。 ", ["e"]), (4, "u4", "d", "page_text", None, ["e"])], UNITS)
    cases = {r["category"]: r for r in evaluation.self_retrieval(units).collect()}
    assert cases["paragraph_chunk"]["eval_case_id"] == "qe_ec14d6de33e532d8e350aa35c479a99f"
    assert cases["table_row"]["query"] == "x 台座 12" and "page_text" not in cases


def test_metrics(spark):
    hits = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "x"), ("q2", 1, "x"), ("q2", 3, "b")], "query_id string, rank int, search_unit_id string")
    relevance = spark.createDataFrame([("q1", "c", "a"), ("q2", "c", "b"), ("q2", "c", "lost"), ("q3", "d", "z")], "query_id string, category string, relevant_id string")
    got = {r["category"]: r for r in evaluation.metrics(evaluation.outcomes(hits, relevance)).collect()}
    assert got["all"]["mrr"] == pytest.approx((1 + 1 / 3 + 0) / 3) and got["all"]["hit_1"] == pytest.approx(1 / 3)
    assert got["c"]["recall_3"] == pytest.approx(0.75) and got["d"]["mrr"] == 0


def test_remap_and_review(spark):
    old = spark.createDataFrame([("o1", "d", "t"), ("o2", "d", None)], "search_unit_id string, document_id string, search_text string")
    new = spark.createDataFrame([("n1", "d", "t"), ("n2", "d", None), ("n3", "d", None)], "search_unit_id string, document_id string, search_text string")
    cases = spark.createDataFrame([("c1", "o1"), ("c2", "o2"), ("c3", "o9")], "eval_case_id string, relevant_id string")
    got = {r["eval_case_id"]: (r["new_id"], r["n_candidates"]) for r in evaluation.remap(cases, old, new, ["document_id", "search_text"]).collect()}
    assert got == {"c1": ("n1", 1), "c2": (None, 2), "c3": (None, 0)}
    drafts = spark.createDataFrame(
        [("good", "台座", ["u1"], "table_row", True, "read", ["p1"]), ("bad", "。", ["u1", "u1", "nix"], "page_text", False, "", ["p", "p"]), ("twin", "台座", [], "odd", True, "read", [])],
        "eval_case_id string, query string, relevant_ids array<string>, category string, reviewed boolean, method string, source_locations array<string>",
    )
    units = spark.createDataFrame([("u1", "table_row")], "search_unit_id string, unit_type string")
    found = {}
    for r in evaluation.review_violations(drafts, units).collect():
        found.setdefault(r["eval_case_id"], set()).add(r["check"])
    assert found["good"] == {"query repeated"}
    assert len(found["bad"]) == 6 and found["twin"] >= {"no relevant unit", "unknown category", "query repeated"}


def test_glossary(spark):
    cells = spark.createDataFrame([("HK、北斗", "北斗更新", 1), ("H", "短い", 2), ("同じ", "同じ", 3), ("HK", "港見", 4)], "alias string, canonical string, ord int")
    made = glossary.build(cells)
    assert {(r["alias"], r["canonical"]) for r in made.collect()} == {("HK", "北斗更新"), ("北斗", "北斗更新"), ("HK", "港見")}
    asked = spark.createDataFrame([(1, "HKの北斗"), (2, "HKX"), (3, None)], "query_id int, query string")
    got = {r["query_id"]: r for r in glossary.expand(asked, made).collect()}
    assert got[1]["expanded"].endswith("- HK = 北斗更新 / 港見\n- 北斗 = 北斗更新") and got[1]["names"] == ["北斗更新", "港見"]
    assert got[2]["expanded"] == "HKX" and got[3]["names"] == []


def test_searches_ask_every_twentieth_unit(spark, tmp_path):
    from shiori.plans import catalogue

    rows = [(k, f"u{k}", "d", "page_text", f"word{k} common", [f"e{k}"]) for k in range(1, 2_401)]
    text = "struct(search_text) as text"
    spark.createDataFrame(rows, UNITS).selectExpr("unit_seq", "search_unit_id", "document_id", "unit_type", text, "source_evidence_ids").write.parquet(str(tmp_path / "search_units.parquet"))
    cases = catalogue._cases(spark, str(tmp_path)).select("unit_seq").collect()
    assert {r["unit_seq"] for r in cases} == set(range(20, 2_401, 20)) and len(cases) == 120
    assert catalogue.bm25_search(spark, str(tmp_path)).select("query_id").distinct().count() == 120
    assert catalogue.self_eval_cases(spark, str(tmp_path)).count() == 100


def test_every_twentieth_document_is_a_question(spark, tmp_path):
    from shiori.plans import catalogue

    rows = [(k, None if k % 40 == 0 else f"s{k % 3}", "北斗更新", f"a.md{k}", f"doc{k}  common " + "filler " * 20 + f"tail{k}") for k in range(1, 1_601)]
    spark.createDataFrame(rows, "doc_id long, source string, project string, file_name string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    asked = {r["query_id"]: r["query"] for r in catalogue._questions(spark, str(tmp_path)).collect()}
    assert set(asked) == set(range(20, 1_601, 20))
    assert all(q == f"北斗更新 doc{k} common " + "filler " * 20 + f"tail{k}" for k, q in asked.items())
    assert catalogue.legacy_search(spark, str(tmp_path)).select("query_id").distinct().count() == 80


def test_aliases_anywhere_in_the_text_are_expanded(spark, tmp_path):
    from shiori.plans import catalogue

    rows = [(1, "港見湾岸", "前" * 100 + " 北斗 の件"), (2, "北斗更新", "短い文")]
    spark.createDataFrame(rows, "doc_id long, project string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["query_id"]: r for r in catalogue.glossary_expand(spark, str(tmp_path)).collect()}
    assert set(got[1]["names"].split(",")) == {"港見湾岸", "北斗更新"} and got[2]["names"] == "北斗更新"
    assert got[1]["expanded"].startswith("港見湾岸: " + "前" * 100 + " 北斗 の件")


def test_groups_of_queries_follow_their_hits_and_memory_is_bounded(spark, monkeypatch):
    """a task's group holds a bounded number of hits, and reranking in groups gives what one group gives."""
    from shiori.operators import scoring

    rows = [(k, f"u{k}", f"d{k % 3}", "table_row", f"品名: 台座{k % 5}\n数量: {k % 7 + 10}\n状態: 完了", [f"h{k % 3}"] + ["x"] * (k % 2) + [f"y{k}"] * (k % 5 == 0)) for k in range(60)]
    idx = index.build(spark.createDataFrame(rows, UNITS))
    asked = queries(spark, *[f"台座{k % 5} {k % 7 + 10} 完了" for k in range(12)])
    take = lambda: sorted(map(tuple, lexical.search(idx, asked, 50).select("query_id", "rank", "unit_seq", F.round("score", 9), "parent_context_penalty", "exact_field_value_matches").collect()))
    whole = take()
    assert any(r[4] for r in whole) and len(whole) == 600
    monkeypatch.setattr(scoring, "HITS", 100)
    monkeypatch.setattr(lexical, "COVERED", 5)
    assert take() == whole
    files = scoring.files_of(idx.forward)
    assert files and all(f.endswith(".parquet") for f in files)
    best = scoring.top_scores(idx.forward, lexical.cut(lexical.query_lists(lexical.with_idf(idx, lexical.query_terms(asked)))), 50, 1.2, 0.75, idx.average_length)
    assert best.rdd.getNumPartitions() == 8


def test_bounds_leave_out_only_what_cannot_rank(spark, monkeypatch):
    """a search that meets the questions' own projects first has the hits of one that meets all chunks, and decodes fewer."""
    from shiori.operators import legacy, scoring

    kinds = ["北斗更新", "青波統合", "灯台移行", None]
    rows = [(k, "p", kinds[k % 4], f"note_{k}.txt", "", f"common{k % 9} word{k % 23} mark{k % 5} own{k}") for k in range(2_000)]
    chunks = spark.createDataFrame(rows, "cid long, path string, project string, filename string, location string, text string").repartition(3)
    few = [("few", "北斗更新 own1 own2", []), ("none", "青波統合 absent", []), ("file", "灯台移行 common1 note_5.txt word3 mark2", [])]
    made = [(f"q{k}", f"{kinds[k % 4] or ''} common{k % 9} word{k % 23} mark{k % 5} own{k}", []) for k in range(90)]
    asked = spark.createDataFrame(few + made, "query_id string, query string, names array<string>")
    monkeypatch.setattr(legacy, "GROUP_BYTES", 20_000)
    idx = legacy.chunk_index(chunks)
    take = lambda: sorted(map(tuple, legacy.search(chunks, asked, index=idx).select("query_id", "rank", "cid", F.round("score", 7), F.round("base_score", 7)).collect()))
    bounded = take()
    monkeypatch.setattr(legacy, "top_scores", lambda *a, reach=None, real=scoring.top_scores, **kw: real(*a, **kw))
    assert take() == bounded and {r[0] for r in bounded} >= {"few", "file"} and "none" not in {r[0] for r in bounded}

    import pyarrow as pa
    import pyarrow.parquet as pq

    files = scoring.files_of(idx.forward)
    assert all(len(set(pq.read_table(f.removeprefix("file:"), columns=["project"]).column(0).to_pylist())) == 4 for f in files)
    needed = lambda part: pa.compute.equal(part.column("project"), "北斗更新").fill_null(False).to_numpy(zero_copy_only=False)
    got = pa.concat_tables([t.select(["unit_seq", "project"]) for t in scoring.read_needed(files, ["unit_seq", "terms", "project"], ["project"], 100, ("terms.list.element",), needed)])
    assert got.num_rows == 500 and set(got.column("project").to_pylist()) == {"北斗更新"}


def test_pairs_are_counted_by_array_as_one_by_one():
    """the counts of word_pair_counts are those of the tokens."""
    from collections import Counter

    from shiori.functions.text import word_pair_counts, word_pair_tokens

    texts = [None, "", "  \n", "漢", "𠀀漢字Ⅲ株㈱ﾊﾟ Σας", "a.b-c _x 1 a.b-c", "ー\n漢字漢字", "ＡＢｃ日本語日本語", "a漢b字字"]
    text, tokens, counts = word_pair_counts(texts)
    got = [{} for _ in texts]
    for k, t, n in zip(text.tolist(), tokens.to_pylist(), counts.tolist()):
        got[k][t] = n
    assert got == [dict(Counter(word_pair_tokens(t or ""))) for t in texts] and len(word_pair_counts([])[0]) == 0
