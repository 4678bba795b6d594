import random

from pyspark.sql import functions as F

from shiori.llm.splitting import LIMIT, OVERLAP, cohesion_depths, split_oversized, split_text, _words

SCHEMA = "table_name string, record_id string, document_id string, locator string, text string"


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert c == max(0, b - overlap) and b < d
        assert text[c:b] == text[max(0, b - overlap) : b]
    assert all(0 < b - a <= limit for a, b in pieces)
    # Without the overlaps the pieces give the text back.
    assert "".join(text[max(a, prev) : b] for (a, b), prev in zip(pieces, [0, *[p[1] for p in pieces]])) == text
    return pieces


def test_round_trip_of_random_texts():
    rng = random.Random(3)
    alphabet = ["台座の数を確かめる。", "a ", "Word. ", "\n", "、", "👷🏽‍♀️", "𠮷", "x" * 70, "é", "é", "!", " "]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400)))
        limit = rng.choice([40, 100, 300])
        check(text, limit, rng.choice([0, 10, limit - 1 if limit < 60 else 30]))


def test_limits():
    assert split_text("") == [] and split_text("a" * LIMIT) == [(0, LIMIT)]
    assert len(check("a" * (LIMIT + 1), LIMIT, OVERLAP)) == 2
    check("a" * 50_000, LIMIT, OVERLAP)


def test_cuts_follow_sentences_and_clusters():
    text = "".join(f"第{k}の文はここで終わる。" for k in range(300))
    assert all(text[b - 1] == "。" for _, b in check(text, 200, 20)[:-1])
    flags = "🇯🇵" * 400
    assert all(b % 2 == 0 for _, b in check(flags, 101, 10)[:-1])
    marks = ("か" + "゙") * 700
    assert all(b % 2 == 0 for _, b in check(marks, 101, 10)[:-1])


def test_cuts_follow_topics():
    one = "".join(f"The pump number {k} moves water through the pump pipe. " for k in range(12))
    two = "".join(f"A violin concert number {k} fills the concert hall. " for k in range(12))
    cut = split_text(one + two, len(one) + 200, 20)[0][1]
    assert cut == len(one)
    depths = cohesion_depths([_words(s) for s in ["pump pipe", "pump pipe", "violin hall", "violin hall"]], 2)
    assert max(range(3), key=lambda k: depths[k]) == 1


def test_records(spark):
    long = "文。" * 700
    rows = [("t", "a", "d", "{}", long), ("t", "a", "d", "{}", long), ("t", "b", None, None, "short"), ("t", "c", "d", None, None), ("t", "d", "d", None, ""), ("u", "a", "d", None, long + "x"), ("t", "e", "d", None, "a" * 1200)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("piece_no", F.lit("clash"))
    got = {}
    for r in split_oversized(df).orderBy("table_name", "record_id", "piece_no").collect():
        got.setdefault((r["table_name"], r["record_id"]), []).append(r)
    assert set(got) == {("t", "a"), ("u", "a")}
    assert [r["piece_no"] for r in got["t", "a"]] == list(range(len(got["t", "a"])))
    assert got["t", "a"][0]["locator"] == "{}" and got["u", "a"][0]["locator"] is None
    assert split_oversized(df.limit(0)).count() == 0
