from pyspark.sql import functions as F

from shiori.operators.containment import contains
from shiori.operators.joins import hot_join, hot_keys
from shiori.operators.sequence import previous, running_last


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hot_join_equals_join(spark):
    left = spark.createDataFrame([(k, "hot" if k % 3 == 0 else f"k{k % 7}" if k % 5 else None) for k in range(300)], "n long, key string")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "key string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert hot_keys(left, ["key"], 90).count() == 1
        assert rows(hot_join(left, right, ["key"], how, 90)) == rows(left.join(right, ["key"], how).select(hot_join(left, right, ["key"], how, 90).columns))


def test_hot_join_of_empty_tables(spark):
    none = spark.createDataFrame([], "key string, v int")
    assert hot_join(none, none.select("key"), ["key"], "left").count() == 0


def test_sequence_does_not_depend_on_chunks(spark):
    data = [("d", k * 7 % 23, f"e{k}", k % 4 == 0, None if k % 6 == 0 else str(k)) for k in range(23)] + [("x", 1, "a", False, "1"), (None, 1, "b", True, "2")]
    df = spark.createDataFrame(data, "doc string, seq long, id string, flag boolean, v string")
    results = []
    for chunk in (3, 1_000):
        last = running_last(df, "doc", ["seq", "id"], {"at": (F.col("flag"), F.col("v"))}, chunk=chunk)
        results.append(rows(previous(last, "doc", ["seq", "id"], {"before": F.col("v")}, chunk=chunk)))
    assert results[0] == results[1]
    expected, held, before = {}, None, None
    for doc, seq, key, flag, v in sorted(d for d in data if d[0] == "d"):
        held = v if flag else held
        expected[key] = (held, before)
        before = v
    got = {r[2]: (r[5], r[6]) for r in results[0] if r[0] == "d"}
    assert got == expected


def test_containment(spark):
    texts = spark.createDataFrame([(1, "use OCR-x and 東京都"), (2, "OCR here"), (3, None), (4, "")], "id int, text string")
    names = spark.createDataFrame([("OCR",), ("東京",), ("",), (None,), ("a long pattern that is nowhere",), ("and 東京都",)], "name string")
    assert rows(contains(texts, "id", "text", names, "name").select("id", "name")) == [(1, "OCR"), (1, "and 東京都"), (1, "東京"), (2, "OCR")]
    assert rows(contains(texts, "id", "text", names, "name", words=True).select("id", "name")) == [(1, "and 東京都"), (1, "東京"), (2, "OCR")]
    assert contains(texts, "id", "text", names.limit(0), "name").count() == 0
