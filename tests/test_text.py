import pytest
from pyspark.sql import functions as F

from shiori.functions import ids
from shiori.functions import text as T


def values(spark, texts, column):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["v"] for r in df.withColumn("f", T.compatible_fold("t")).withColumn("l", T.compatible_lower("t")).select("k", column.alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("ＡＢＣ東京都12", "w:abc j2:東京 j2:京都 j3:東京都 w:12"),
        ("für", "w:f w:ü w:r"),
        ("Straße", "w:strasse"),
        ("都", "j1:都"),
        ("a_b-c", "w:a w:b w:c"),
        ("½", "w:1 w:2"),
        ("データ・表", "j2:デー j2:ータ j2:タ・ j2:・表 j3:データ j3:ータ・ j3:タ・表"),
        ("", ""),
        (" \n", ""),
    ],
)
def test_script_run_tokens(spark, text, tokens):
    assert values(spark, [text], T.tokens_a(F.col("f"))) == [tokens.split()]
    assert T.script_run_tokens(text) == tokens.split()


def test_words_before_pairs(spark):
    assert values(spark, ["für a_b.c 東京都 x-1", None], T.tokens_b(F.col("l"))) == [["f", "r", "a_b.c", "x-1", "東京", "京都"], None]
    assert T.word_pair_tokens("für a_b.c 東京都 x-1") == ["f", "r", "a_b.c", "x-1", "東京", "京都"]


def test_field_values_and_strip(spark):
    text = "工程: 研磨\r\n担当:  製造課　\n空:\nなし\n再: 研磨"
    assert values(spark, [text], T.field_values(F.col("t"))) == [["研磨", "製造課"]]
    assert values(spark, [" 　\x1ca b "], T.strip(F.col("t"))) == ["a b"]


def test_clip_and_collapse(spark):
    assert values(spark, ["abcdef", "abc", None], T.clip(F.col("t"), 3)) == ["abc…", "abc", None]
    assert values(spark, [" a　\n b "], T.collapse_space(F.col("t"))) == ["a b"]


def test_columns(spark):
    assert values(spark, ["A", "Z", "AA", "XFD", "a", ""], T.column_number(F.col("t"))) == [1, 26, 27, 16384, None, None]
    numbers = spark.createDataFrame([(1,), (26,), (27,), (702,), (703,), (16384,)], "n int")
    assert [r[0] for r in numbers.select(T.column_letters(F.col("n"))).collect()] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]


def test_answers(spark):
    assert values(spark, ["<b>12</b>", " わからない。", None, "不明な点はない"], T.plain_answer(F.col("t"))) == ["12", "わかりません", "わかりません", "不明な点はない"]


def test_ids(spark):
    row = spark.range(1).select(
        ids.stable_id("doc", relative_path=F.lit("a/b.txt"), source_sha256=F.lit("0" * 64)).alias("doc"),
        ids.content_hash(F.lit("hello")).alias("content"),
        ids.content_hash(F.lit(None).cast("string"), F.lit("7")).alias("value"),
        ids.content_hash(F.lit(None).cast("string")).alias("none"),
    ).first()
    assert row["doc"] == "doc_fff57077a3b481ef3135d9a2932f1dfa"
    assert row["content"] == "237b5f6f64803bfe541b6a1962b51e9305351aa9a73b52843effe5293093bb4e"
    assert row["value"] and row["none"] is None
