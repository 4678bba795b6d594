import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiori.llm.mixing import _fill, clean_targets, mix, mix_shares, plan_sources, position, with_schedules


def sizes(spark, seed=0):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["hot", "hot", "hot", "a", "b", "c", None]), rng.choice([0, None] + [rng.randrange(1, 40)] * 9)) for k in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")


def targets(spark):
    rows = [("hot", 3.0, 1), ("A ", 1.0, 2), ("a", 1.0, 4), ("b", 2.0, 3), ("c", 0.0, 2), ("none", 4.0, 2), (None, 9.0, 1), ("z", None, 1), ("d", float("nan"), 1)]
    return spark.createDataFrame(rows, "source string, target_weight double, max_repeats int").withColumn("supply", F.lit("clash"))


@pytest.mark.parametrize("total", [None, 20_000, 10**9])
def test_shares_and_caps(spark, total):
    size = sizes(spark)
    goals = targets(spark).drop("supply")
    plan = plan_sources(size, goals, total)
    draws = mix(size, goals, total, buckets=16).collect()
    got = {r["source"]: r for r in mix_shares(spark.createDataFrame(draws), plan).collect()}
    assert set(got) == {"hot", "a", "b", "none"} and got["none"]["tokens"] == 0
    caps = {"hot": 1, "a": 4, "b": 3}
    seen = {}
    for r in draws:
        seen.setdefault((r["source"], r["doc_id"]), []).append(r["repeat_no"])
    assert all(sorted(n) == list(range(1, len(n) + 1)) and len(n) <= caps[s] for (s, _), n in seen.items())
    demand = {r["source"]: r["demand"] for r in plan.collect()}
    assert all(abs(got[s]["tokens"] - demand[s]) <= 1 for s in caps)
    if total != 10**9:
        assert all(got[s]["actual_share"] == pytest.approx(got[s]["reachable_share"], abs=0.01) for s in caps)
    else:
        assert all(got[s]["most_repeats"] == caps[s] for s in caps)
    at = [r["position"] for r in draws]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1


def test_target_rows(spark):
    got = {r["source"]: r for r in clean_targets(targets(spark)).collect()}
    assert set(got) == {"hot", "a", "b", "none"} and got["a"]["target_weight"] == 2.0 and got["a"]["max_repeats"] == 4
    assert sum(r["target_share"] for r in got.values()) == pytest.approx(1)


def test_weights_add_up_at_every_moment(spark):
    plan = [r for r in plan_sources(sizes(spark), targets(spark).drop("supply")).collect() if r["demand"] > 0]
    assert sum(r["reachable_share"] * r["tilt"] for r in plan) == pytest.approx(0, abs=1e-9)
    assert max(abs(r["tilt"]) for r in plan) == pytest.approx(0.5)
    df = spark.createDataFrame([(u / 20, g) for u in range(21) for g in (-0.5, -1e-12, 0.0, 0.3, 1.0)], "u double, tilt double")
    for r in with_schedules(df).select("u", "tilt", position(F.col("u"), F.col("segments")).alias("t")).collect():
        assert r["t"] + r["tilt"] * (r["t"] ** 2 - r["t"]) == pytest.approx(r["u"], abs=1e-9)


def test_given_schedules_are_followed(spark):
    knots = [("Hot", 0.0, 1.0), ("hot", 0.5, 1.0), ("hot", 0.500001, 0.0), ("hot", 1.0, 0.0), ("a", 0.2, 0.0), ("a", 1.0, 2.0), ("b", 0.0, -1.0), ("b", None, 1.0), (None, 0.0, 1.0)]
    schedules = spark.createDataFrame(knots, "source string, progress double, weight double")
    draws = mix(sizes(spark), targets(spark).drop("supply"), schedules=schedules).toPandas()
    hot, a, b = (draws[draws.source == s] for s in ("hot", "a", "b"))
    assert hot.position.max() <= 0.500002 and abs((hot.position < 0.25).mean() - 0.5) < 0.05
    early = a[a.position < 0.6].n_tokens.sum() / a.n_tokens.sum()
    assert a.position.min() >= 0.2 and early == pytest.approx(0.25, abs=0.05)
    assert abs((b.position < 0.5).mean() - 0.5) < 0.05


def test_the_last_round_is_filled_until_nothing_fits(spark):
    # In hash order a large document may come first; the small ones fill its place.
    rows = [(k, "s", 1_000 if k % 3 else 10) for k in range(60)] + [(k, "t", 500) for k in range(100, 110)]
    size = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    goals = spark.createDataFrame([("s", 0.5, 1), ("t", 0.5, 1)], "source string, target_weight double, max_repeats int")
    got = {r["source"]: r["tokens"] for r in mix(size, goals).groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}
    assert got["t"] == 5_000 and abs(got["s"] - 5_000) <= 500
    assert _fill(pd.DataFrame({"source": "s", "gap": 25.0, "n_tokens": [20, 9, 7], "n": [1, 1, 5]})).values.tolist() == [["s", 20, 1], ["s", 7, 1]]


def test_schedule_is_followed(spark):
    draws = mix(sizes(spark), targets(spark).drop("supply")).toPandas()
    plan = {r["source"]: r for r in plan_sources(sizes(spark), targets(spark).drop("supply")).collect()}
    for source, part in draws.groupby("source"):
        early = part[part.position < 0.5].n_tokens.sum() / part.n_tokens.sum()
        assert early == pytest.approx(0.5 - plan[source]["tilt"] / 4, abs=0.03)


def test_empty_tables(spark):
    none = sizes(spark).limit(0)
    assert mix(none, targets(spark).drop("supply")).count() == 0
    assert mix(sizes(spark), targets(spark).drop("supply").limit(0)).count() == 0
