import random

import pytest
from pyspark.sql import functions as F

from shiori.llm import termcounts
from shiori.llm.lookalike import fold_width


def brute(terms, postings, units):
    once = {}
    for i, t in terms:
        if i is not None:
            old = once.get(i)
            once[i] = t if old is None else old if t is None else min(old, t)
    key = {i: ("n", i) if t is None else ("t", fold_width(t).lower()) for i, t in once.items()}
    first = {}
    for i, k in key.items():
        first[k] = min(first.get(k, i), i)
    best = {}
    for t, u, f in postings:
        if t is not None and u in units and u is not None and f is not None and f > 0:
            best[t, u] = max(best.get((t, u), 0), f)
    n = len({u for _, u in best})
    out = {}
    for i, k in key.items():
        total, seen = out.setdefault(first[k], [0, set()])
        mine = {u: f for (t, u), f in best.items() if t == i}
        out[first[k]] = [total + sum(mine.values()), seen | set(mine)]
    return {i: (total, len(seen), n, len(seen) <= 2, len(seen) > 0 and len(seen) >= 0.15 * n) for i, (total, seen) in out.items()}


def run(spark, terms, postings, units, **options):
    t = spark.createDataFrame(terms, "term_id long, term string").withColumn("number", F.lit("clash"))
    p = spark.createDataFrame(postings, "term_id long, doc_rowid long, term_frequency long").withColumn("unit_seq", F.lit(1))
    u = spark.createDataFrame([(x,) for x in units], "unit_seq long")
    return {r["term_id"]: tuple(r)[1:] for r in termcounts.term_counts(t, p, u, **options).collect()}


@pytest.mark.parametrize("block, hot", [(4096, 1_000_000), (4, 50)])
def test_random_index(spark, monkeypatch, block, hot):
    monkeypatch.setattr(termcounts, "BLOCK", block)
    rng = random.Random(4)
    terms = [(k, rng.choice(["w:Ab", "w:ａｂ", "w:AB", f"w:{k}", "ｶﾞ", "ガ", None, ""])) for k in range(1, 40)]
    terms += terms[:5] + [(None, "w:x")]
    units = [*range(60), None, 3]
    postings = [(rng.choice([*range(1, 45), 1, 1, 1, None]), rng.choice([*range(70), None]), rng.choice([0, 1, 2, None])) for _ in range(900)]
    postings += postings[:50]
    assert run(spark, terms, postings, units, hot_rows=hot) == brute(terms, postings, set(units))


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)], [1]) == {}
    assert run(spark, [(1, "a")], [], []) == {1: (0, 0, 0, True, False)}


def test_numbers_have_no_gaps(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "v")
    rows = termcounts.dense_ids(df, "v", "n").collect()
    assert {r["v"]: r["n"] for r in rows} == {v: k for k, v in enumerate(range(0, 1000, 7))}
    assert termcounts.dense_ids(df.limit(0), "v", "n").count() == 0
