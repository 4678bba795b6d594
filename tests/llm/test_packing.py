import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from shiori.llm import packing, tokens
from shiori.llm.packing import fill_containers, pack

SIZES = "doc_id long, source string, n_tokens int, copies string"


def test_best_fit_takes_the_tightest_bin():
    items = [(60, None, "a"), (50, None, "b"), (45, None, "c"), (38, None, "d")]
    assert pack(items, 100) == [0, 1, 1, 0]


def test_conflicts():
    items = [(30, "s", "same"), (30, "t", "same"), (30, "u", "other")]
    bins = pack(items, 100, slack=2.0)
    assert bins[0] != bins[1] and bins[2] in bins[:2]
    same_source = pack([(30, "s", str(k)) for k in range(3)] + [(60, "t", "x")], 100, source_limit=2)
    assert len(set(same_source)) == 2


def test_random_items():
    rng = random.Random(6)
    items = [(rng.randrange(1, 2049) if k % 3 else rng.randrange(1, 300), rng.choice(["hot", "a", "b", None]), rng.choice(["c", str(k)]) if k % 9 == 0 else str(k)) for k in range(3000)]
    bins = pack(items)
    room, copies, sources = Counter(), defaultdict(Counter), defaultdict(Counter)
    for b, (n, s, c) in zip(bins, items):
        room[b] += n
        copies[b][c] += 1
        if s:
            sources[b][s] += 1
    assert max(room.values()) <= 2048 and sum(room.values()) == sum(n for n, _, _ in items)
    assert len(room) <= 1.04 * sum(room.values()) / 2048
    met = sum(n - 1 for c in copies.values() for n in c.values())
    assert met <= 0.05 * sum(c == "c" for _, _, c in items)
    assert np.mean([n > 2 for c in sources.values() for n in c.values()]) < 0.1


def test_a_hot_text_does_not_empty_the_containers():
    items = [(5, "s", "hot")] * 3000 + [(680, "t", str(k)) for k in range(300)]
    assert len(set(pack(items))) <= 1.04 * -(-sum(n for n, _, _ in items) // 2048) + 1


def test_pieces_of_tables(spark):
    rows = [(1, "a", 5000, "x"), (2, "a", 2048, "y"), (3, None, 10, "z"), (4, "b", 0, "e"), (5, "b", None, "n"), (6, "b", 2047, "q")] + [(k, "hot", 100 + k % 7, "same") for k in range(10, 400)]
    df = spark.createDataFrame(rows, SIZES).withColumn("lane", F.lit("clash"))
    got = fill_containers(df, lane_items=100).collect()
    per_doc, fill = defaultdict(list), Counter()
    for r in got:
        per_doc[r["doc_id"]].append((r["piece_no"], r["token_start"], r["n_tokens"]))
        fill[r["container_id"]] += r["n_tokens"]
    assert max(fill.values()) <= 2048
    assert sorted(per_doc[1]) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)] and per_doc[2] == [(0, 0, 2048)]
    assert 4 not in per_doc and 5 not in per_doc
    assert all(len(v) == 1 for d, v in per_doc.items() if d != 1) and len(per_doc) == len(rows) - 2
    assert fill_containers(df.limit(0)).count() == 0


def test_token_counts(spark):
    encode = tokens.encoder().encode_ordinary
    rows = [(1, "Plain words here.", " Share-A"), (1, "Plain words", "x"), (2, "", None), (3, None, "s"), (4, "来期の予定を確認する。" * 500, "S"), (5, "Ｐlain words here.", "s"), (None, "x", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit(1))
    got = {r["doc_id"]: r for r in tokens.with_sizes(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1]["n_tokens"] == len(encode("Plain words here.")) and got[1]["source"] == "share_a"
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == 0 and got[4]["n_tokens"] == len(encode(rows[4][1]))
    assert got[1]["copies"] == got[5]["copies"] != got[4]["copies"]
    assert packing.fill_containers(tokens.with_sizes(df)).agg(F.sum("n_tokens")).first()[0] == sum(r["n_tokens"] for r in got.values())
