import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from shiori.llm.lookalike import _tables, alike_classes, alike_pairs, clean_form, consistent_forms, fold_width, visible_form, with_visible_form


def slow(text):
    """Every character mapped, then the whole composed."""
    mapped = _tables()[0]
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").translate(mapped))


@pytest.mark.parametrize(
    "a, b",
    [
        ("ＢＯＸ　Ａ－１", "BOX A-1"),
        ("ｶﾞｽ圧ｾﾝｻｰ", "ガス圧センサー"),
        ("カﾞス", "ガス"),
        ("Café d­​é﻿jà", "Café déjà"),
        ("e​́", "é"),
        ("Ѕіtе ассеѕѕ", "Site access"),
        ("ΒΟΧ", "BOX"),
        ("ロ径 工ルボ 夕ンク 卜ルク 力ネツ 八ーネス", "口径 エルボ タンク トルク カネツ ハーネス"),
        ("50Ω Å µm", "50Ω Å μm"),
        ("a b c　d\te", "a b c d e"),
        ("a\r\nb\rc d", "a\nb\nc\nd"),
        ("ё", "ë"),
        ("ベへ", "べヘ"),
        ("⼈", "人"),
    ],
)
def test_same_look(a, b):
    assert visible_form(a) == visible_form(b)


@pytest.mark.parametrize("a, b", [("A", "a"), ("e", "é"), ("カ", "ガ"), ("2", "²"), ("3", "₃"), ("1", "①"), ("ツ", "ッ"), ("a b", "ab"), ("a\nb", "a b"), ("O", "0"), ("l", "1"), ("a  b", "a b")])
def test_different_look(a, b):
    assert visible_form(a) != visible_form(b)


def test_segments_equal_the_whole():
    rng = random.Random(1)
    alphabet = "aeoか力一カﾞﾟｶ゙́̀​‍️\r\n  éЁΟ𠮷👷한ᅡᆨ각①²ẋ̣ṩ"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 12)))
        assert visible_form(text) == slow(text), ascii(text)
        assert visible_form(visible_form(text)) == visible_form(text), ascii(text)


def test_width_alone():
    assert fold_width("Ａｶﾞ①é") == "Aガ①é" and fold_width("éﾞ") == "é゙" and fold_width("") == ""


def records(spark, rows):
    return spark.createDataFrame(rows, "table_name string, record_id string, document_id string, text string")


def brute(rows):
    out = set()
    rows = sorted({r for r in rows if None not in r})
    for a, b in itertools.product(rows, rows):
        if a[0] == b[0] and a[2] == b[2] and a[1] < b[1] and a[3] != b[3] and slow(a[3]) == slow(b[3]):
            out.add((a[0], a[1], b[1]))
    return out


@pytest.mark.parametrize("options", [{}, {"block_rows": 3, "hot_rows": 20}])
def test_pairs(spark, options):
    rng = random.Random(2)
    texts = ["ABC", "ＡＢＣ", "АВС", "A​BC", "abc", "", "​", None, "x" * 5000, "x" * 4999 + "х"]
    rows = [(rng.choice(["t", "u"]), f"r{k:03d}", rng.choice(["d", "d", "e", "", None]), rng.choice(texts)) for k in range(200)]
    rows += rows[:20] + [("t", None, "d", "ABC")]
    df = records(spark, rows).withColumn("form", F.lit("clash")).withColumn("blocks", F.lit(1))
    assert {tuple(r) for r in alike_pairs(df, **options).collect()} == brute(rows)


def test_hot_group_of_equal_texts(spark):
    rows = [("t", f"r{k:04d}", "d", "同じ") for k in range(900)] + [("t", "z", "d", "同​じ")]
    assert alike_pairs(records(spark, rows), block_rows=50, hot_rows=100).count() == 900
    assert alike_pairs(records(spark, rows[:-1])).count() == 0
    assert alike_pairs(records(spark, rows).limit(0)).count() == 0


def test_form_column(spark):
    df = records(spark, [("t", "a", "d", "ＡＢ"), ("t", "b", "d", None)])
    assert [r["form"] for r in with_visible_form(df).orderBy("record_id").collect()] == ["AB", None]
    with pytest.raises(ValueError):
        with_visible_form(df.withColumn("form", F.lit(1)))


@pytest.mark.parametrize("text", ["工場の入口", "二つ一般的な夕方八時", "口コミとカニの力", "сор и дом", "Ελλάδα", "へいき", "コーヒー", "Ⅳ章 Ⅰ", "ABC-12", ""])
def test_delivered_texts_keep_what_a_reader_can_name(text):
    assert clean_form(text) == text


@pytest.mark.parametrize("a, b", [("Ѕіtе ассеѕѕ", "Site ассеѕѕ"), ("ＡＢＣ　ｶﾞｽ", "ABC ガス"), ("e​́", "é"), ("⼈", "人"), ("Βox", "Box"), ("Ꮪѕi", "Ꮪsi"), ("dеj̀à", "dej̀à")])
def test_delivered_texts_lose_what_a_reader_cannot_see(a, b):
    assert clean_form(a) == unicodedata.normalize("NFC", b)


def test_texts_that_look_alike_are_delivered_alike(spark):
    rows = [("t", "1", "d", "工場"), ("t", "2", "e", "エ場"), ("t", "3", "d", "エ​場"), ("t", "4", "d", "二"), ("u", "5", None, "сор"), ("u", "6", "d", "cop"), ("t", "7", "d", None), ("t", "8", "d", ""), ("t", "1", "d", "工場")]
    got = {r["record_id"]: (r["form"], r["changed"]) for r in consistent_forms(records(spark, rows)).collect()}
    assert got == {"1": ("工場", False), "2": ("工場", True), "3": ("工場", True), "4": ("二", False), "5": ("cop", True), "6": ("cop", False), "8": ("", False)}
    assert consistent_forms(records(spark, rows).limit(0)).count() == 0


def test_classes_hold_the_links_of_the_pairs(spark):
    rng = random.Random(7)
    texts = ["ABC", "ＡＢＣ", "АВС", "abc", "", "​", None, "工", "エ"]
    rows = [(rng.choice(["t", "u"]), f"r{k:03d}", rng.choice(["d", "e", None]), rng.choice(texts)) for k in range(150)]
    pairs = brute(rows)
    got = {(r["table_name"], r["record_id"]): r["n_links"] for r in alike_classes(records(spark, rows)).collect()}
    want = {}
    for t, a, b in pairs:
        for x in (a, b):
            want[t, x] = want.get((t, x), 0) + 1
    assert got == want and len(want) > 50
    assert alike_classes(records(spark, rows).limit(0)).count() == 0
