import hashlib
import pathlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shiori import session
from shiori.operators import answers, charts, containment, index, legacy, lexical, mining, scoring
from shiori.sources import indexes

UNITS = "unit_seq long, search_unit_id string, document_id string, unit_type string, search_text string, source_evidence_ids array<string>"


def units(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)]
    return spark.createDataFrame([(k, f"u{k}", f"d{k % 3}", "page_text", " ".join(rng.choice(words, rng.integers(0, 30))), ["a"]) for k in range(n)], UNITS)


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query_id string, query string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["unit_seq"], round(r["lexical_score"], 9), r["matched_terms"]) for r in df.collect())


def test_blocks_of_any_size_give_the_brute_force_ranking(spark, monkeypatch):
    idx = index.build(units(spark))
    queries = asked(spark, "w1 w2 w3", "w5", "w9 w10 w11 w12 w59", "unknown", None)
    whole = rows(lexical.search_bm25(idx, queries, 7))
    counts = {r["unit_seq"]: dict(zip(r["terms"], r["tfs"])) for r in idx.forward.collect()}
    df = {r["term"]: r["document_frequency"] for r in idx.terms.collect()}
    want = []
    for q, text in (("q0", "w1 w2 w3"), ("q1", "w5"), ("q2", "w9 w10 w11 w12 w59")):
        scores = {}
        for u, tf in counts.items():
            hit = [t for t in ("w:" + w for w in text.split()) if t in tf]
            if hit:
                norm = 1.2 * (0.25 + 0.75 * sum(tf.values()) / idx.average_length)
                scores[u] = (sum(np.log(1 + (idx.n_documents - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + norm) for t in hit), len(hit))
        best = sorted(scores.items(), key=lambda x: (-round(x[1][0], 8), x[0]))[:7]
        want += [(q, k + 1, u, round(s, 9), n) for k, (u, (s, n)) in enumerate(best)]
    assert whole == sorted(want)
    monkeypatch.setattr(scoring, "QUERY_TERMS", 2)
    monkeypatch.setattr(scoring, "UNIT_ROWS", 20)
    monkeypatch.setattr(scoring, "CELLS", 30)
    assert rows(lexical.search_bm25(idx, queries, 7)) == whole


def test_a_lexical_index_comes_back_as_it_was(spark, tmp_path):
    idx = index.build(units(spark))
    path = str(tmp_path / "index")
    queries = asked(spark, "w1 w2 w3", "w7 w8")
    want, one = rows(lexical.search_bm25(idx, queries, 5)), idx.forward.limit(1).toPandas()
    indexes.write_lexical(idx, path, "source-1")
    back = indexes.read_lexical(spark, path, source="source-1")
    assert (back.n_documents, back.average_length) == (idx.n_documents, idx.average_length)
    assert rows(lexical.search_bm25(back, queries, 5)) == want
    with pytest.raises(indexes.IndexMismatch, match="tokenizer"):
        indexes.read_lexical(spark, path, kind="b")
    with pytest.raises(indexes.IndexMismatch, match="source"):
        indexes.read_lexical(spark, path, source="source-2")
    spark.createDataFrame(one, back.forward.schema).write.mode("append").parquet(f"{path}/forward")
    with pytest.raises(indexes.IndexMismatch, match="forward"):
        indexes.read_lexical(spark, path)


def test_a_vector_index_is_checked_when_read(spark, tmp_path):
    vectors = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0])], "unit_seq long, search_unit_id string, vector array<double>")
    path = str(tmp_path / "vectors")
    indexes.write_vectors(vectors, path, "m", 2)
    assert indexes.read_vectors(spark, path, "m", 2).count() == 2
    for model, size, name in (("n", 2, "model"), ("m", 3, "dimensions")):
        with pytest.raises(indexes.IndexMismatch, match=name):
            indexes.read_vectors(spark, path, model, size)
    vectors.limit(1).write.mode("append").parquet(f"{path}/vectors")
    with pytest.raises(indexes.IndexMismatch, match="vectors"):
        indexes.read_vectors(spark, path, "m", 2)


@pytest.mark.parametrize("words", [False, True])
def test_both_ways_to_find_patterns_agree(spark, words):
    texts = spark.createDataFrame([(1, "the cat sat"), (2, "concat-cat"), (3, None), (4, ""), (5, "工場の工事"), (6, "cat"), (7, "xcat cat")], "k long, t string")
    patterns = spark.createDataFrame([("cat", 1), ("工", 2), ("the cat sat on", 3), ("", 4), (None, 5), ("cat", 6)], "p string, n int")
    got = [sorted((r["k"], r["p"], r["n"]) for r in containment.contains(texts, "k", "t", patterns, "p", words, limit).collect()) for limit in (100, 0)]
    assert got[0] == got[1] and (5, "工", 2) in got[0] and ((2, "cat", 1) in got[0]) == (not words) and (7, "cat", 6) in got[0]


def test_dates_need_no_marks(spark):
    df = spark.createDataFrame([("20240501 2024-5-1 2024年12月3日 20241231x 1999-01-01",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(mining.dates_in(F.col("t"))).collect()]
    assert got[0] == ["20240501", "20241203", "20241231"] and not got[1] and not got[2]


def test_answers_compare_with_case_but_without_width(spark):
    df = spark.createDataFrame([("ABC", "ＡＢＣ "), ("ABC", "abc")], "e string, p string")
    no = F.lit(False)
    asked_ = spark.createDataFrame([(1, "ABC"), (2, "ABC")], "query_id long, expected string")
    given = spark.createDataFrame([(1, "ＡＢＣ "), (2, "abc")], "query_id long, predicted string")
    chunks = spark.createDataFrame([(1, "nothing")], "cid long, text string")
    hits = spark.createDataFrame([], "query_id long, cid long")
    got = {r["query_id"]: r["category"] for r in answers.diagnose(asked_, given, chunks, hits).collect()}
    assert got == {1: answers.SUCCESS, 2: answers.REVIEW} and df.select(no).count() == 2


def test_projects_are_found_in_any_width(spark):
    chunks = spark.createDataFrame([(1, "P/a", "ＡＢＣ計画", "a.txt", "", "budget plan"), (2, "Q/b", "別件", "b.txt", "", "budget plan")], "cid long, path string, project string, filename string, location string, text string")
    query = spark.createDataFrame([("q", "ABC計画 budget", [])], "query_id string, query string, names array<string>")
    got = {r["cid"]: r["score"] / r["base_score"] for r in legacy.search(chunks, query).collect()}
    assert got == {1: pytest.approx(3.0), 2: pytest.approx(0.25)}


def test_plotting_code_is_mined_by_the_published_marks(spark):
    source = "df = pd.read_excel('data/A.XLS')\nplt.bar(x, y)\nplt.savefig('out/one.WEBP', dpi=100)\nplt.savefig(name, 'two.png')\ndf.groupby('x').sum()"
    cells = spark.createDataFrame([("n.ipynb", "cell-0", source)], "path string, location string, source string")
    row = charts.mined(cells).first()
    assert row["images"] == ["out/one.WEBP"] and row["data"] == ["data/A.XLS"] and row["transforms"] == ["groupby", "sum"] and row["plots"] == ["plt.bar"]


def test_group_tables_are_sorted(spark):
    df = spark.createDataFrame([("10", 1.0), ("9", 2.0), ("x", 3.0), ("1", None)], "d string, v double")
    assert [r["x"] for r in charts.group_table(df, "d", "v").collect()] == [1.0, 9.0, 10.0]
    assert pa.__version__


def test_the_tables_of_an_index_are_moved_not_copied(spark, tmp_path, monkeypatch):
    """what an index kept for its making becomes the stored index, without a second copy on disk."""
    monkeypatch.setattr(index, "cut", lambda df, real=index.cut: kept.append(real(df)) or kept[-1])
    kept = []
    idx = index.build(units(spark))
    before = {f.rsplit("/", 1)[1] for f in session.files_of(idx.forward)}
    indexes.write_lexical(idx, str(tmp_path / "moved"))
    assert {p.name for p in (tmp_path / "moved" / "forward").glob("*.parquet")} == before
    assert not any((pathlib.Path(df._shiori_path)).exists() for df in kept)
    with pytest.raises(FileExistsError):
        session.move(session.cut(units(spark)), str(tmp_path / "moved" / "forward"))


def test_patterns_are_sought_with_one_automaton(monkeypatch):
    """a task builds its automaton once, however many texts it has, and hashes no patterns for each."""
    made = []
    monkeypatch.setattr(containment, "automaton", lambda p, real=containment.automaton: made.append(p) or real(p))
    batches = [pa.RecordBatch.from_arrays([pa.array([k, k + 1]), pa.array(["xaby", None])], names=["cid", "text"]) for k in (0, 2)]
    found = [b.to_pylist() for b in containment._finder(("ab", "a", "q"), False, "cid", "p")(iter(batches))]
    assert found == [[{"cid": k, "p": "a"}, {"cid": k, "p": "ab"}] for k in (0, 2)] and len(made) == 1


def test_questions_that_expect_the_same_are_not_rows_by_chunks(spark, monkeypatch):
    """chunks meet distinct answers, so many questions of one answer add no rows."""
    met = []
    monkeypatch.setattr(answers, "contains", lambda *a, real=containment.contains: met.append(real(*a)) or met[-1])
    asked_ = spark.createDataFrame([(k, "same" if k else "gone") for k in range(30)], "query_id long, expected string")
    given = spark.createDataFrame([(1, "same")], "query_id long, predicted string")
    chunks = spark.createDataFrame([(k, "the same text") for k in range(20)] + [(99, "other")], "cid long, text string")
    hits = spark.createDataFrame([(1, 3), (2, 3), (3, 99)], "query_id long, cid long")
    got = {r["query_id"]: (r["in_corpus"], r["in_top"]) for r in answers.diagnose(asked_, given, chunks, hits).collect()}
    assert got[0] == (False, False) and got[2] == (True, True) and got[3] == (True, False) and len(got) == 30
    assert met[0].count() == 20


def test_what_is_shown_of_a_block_is_taken_before_the_join(spark):
    """the texts of chunks don't travel to their hits where only a digest of the block is shown."""
    chunks = spark.createDataFrame([(1, "p", "", "x" * 9), (2, "q", "a", "y" * 9)], "cid long, path string, location string, text string")
    hits = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "query_id long, rank int, cid long")
    whole = {r["cid"]: (r["block"], r["used"]) for r in legacy.context(hits, chunks, 100).collect()}
    shown = {r["cid"]: (r["block"], r["used"]) for r in legacy.context(hits, chunks, 100, F.md5).collect()}
    assert set(whole) == {1, 2} and shown == {c: (hashlib.md5(b.encode()).hexdigest(), u) for c, (b, u) in whole.items()}
