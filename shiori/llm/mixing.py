"""Mixing sources to target weights along a time-varying curriculum (problem 8).

Each source has a weight schedule over training progress t in 0..1: lines between given knots, or else the
line share * (1 + tilt * (2t - 1)); its integral is the source's share. Integrated, it gives the source's
cumulative token demand; inverting that demand at the tokens drawn so far gives each draw its training
position, and the draws are range-sorted by position. Without given schedules, sources that must be repeated
more come later: their tilt is positive, and the tilts balance out, so that the weights add up to one at
every moment.

Cumulative tokens of a source come from sums over BUCKETS hash buckets and running sums within one, so
a source that holds a third of all rows is spread over as many tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from .tokens import TOKENIZER, source_name, with_sizes

BUCKETS = 4_096
#: Largest slope of a schedule; 0 mixes evenly over the whole training.
TILT = 0.5


def clean_targets(targets: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, target_share): one row per source with a positive weight.

    Several rows of a source add up their weights and take the largest cap; a null cap is 1.
    """
    good = targets.where((F.col("target_weight") > 0) & ~F.isnan("target_weight") & F.col("source").isNotNull())
    each = good.groupBy(source_name().alias("source")).agg(F.sum("target_weight").alias("target_weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    return each.withColumn("target_share", F.col("target_weight") / F.sum("target_weight").over(Window.partitionBy()))


def plan_sources(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, tilt: float = TILT) -> DataFrame:
    """One row per target source: what it holds, what is asked of it, and its schedule's tilt.

    Without total_tokens the mixture is the largest in which every source with documents meets its share
    within its cap. With it, sources that can't meet their demand give all they may.
    """
    supply = sizes.where(F.col("n_tokens") > 0).groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n_documents"))
    rows = clean_targets(targets).join(supply, "source", "left").fillna(0, ["supply", "n_documents"])
    every = Window.partitionBy()
    there = F.when((F.col("supply") > 0) & (F.col("max_repeats") > 0), F.col("target_weight"))
    rows = rows.withColumn("reachable_share", there / F.sum(there).over(every))
    most = F.col("supply") * F.col("max_repeats")
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.min(most / F.col("reachable_share")).over(every)
    rows = rows.withColumn("demand", F.coalesce(F.least(most.cast("double"), F.col("reachable_share") * total), F.lit(0.0)))
    rows = rows.withColumn("repeats", F.when(F.col("supply") > 0, F.col("demand") / F.col("supply")).otherwise(0.0))
    off = F.col("repeats") - F.sum(F.col("repeats") * F.coalesce("reachable_share", F.lit(0.0))).over(every)
    rows = rows.withColumn("off", F.when(F.col("demand") > 0, off).otherwise(0.0))
    top = F.max(F.abs("off")).over(every)
    return rows.withColumn("tilt", F.when(top > 1e-12, F.lit(tilt) * F.col("off") / top).otherwise(0.0)).drop("off")


def _segments(rows: pd.DataFrame) -> pd.DataFrame:
    """A source's schedule as integrated pieces; weights that are no positive number count as 0."""
    at = rows["progress"].clip(0.0, 1.0)
    weight = rows["weight"].where(rows["weight"] > 0, 0.0).fillna(0.0)
    knots = sorted(dict(zip(at, weight)).items())
    knots = [(0.0, knots[0][1])] * (knots[0][0] > 0) + knots + [(1.0, knots[-1][1])] * (knots[-1][0] < 1)
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    if area <= 0:
        knots, area = [(0.0, 1.0), (1.0, 1.0)], 1.0
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        more = (t1 - t0) * (w0 + w1) / 2 / area
        if more > 0:
            out.append((t0, w0 / area, (w1 - w0) / area / (t1 - t0), done, done + more))
            done += more
    out[-1] = (*out[-1][:4], 1.0)
    return pd.DataFrame([(rows["source"].iloc[0], [dict(zip(("t0", "w0", "slope", "c0", "c1"), o)) for o in out])], columns=["source", "segments"])


SEGMENTS = "array<struct<t0:double,w0:double,slope:double,c0:double,c1:double>>"


def with_schedules(plan: DataFrame, schedules: DataFrame | None = None) -> DataFrame:
    """plan with the integrated schedule of each source.

    schedules: source, progress (0..1), weight: knots between which a source's weight runs in a line, before
    the first and after the last of which it stays; only its shape counts, its integral is the source's
    share. Sources without knots, and all without schedules, follow the line of their tilt.
    """
    one = F.array(F.struct(F.lit(0.0).alias("t0"), (1 - F.col("tilt")).alias("w0"), (2 * F.col("tilt")).alias("slope"), F.lit(0.0).alias("c0"), F.lit(1.0).alias("c1"))).cast(SEGMENTS)
    if schedules is None:
        return plan.withColumn("segments", one)
    knots = schedules.where(F.col("source").isNotNull() & F.col("progress").isNotNull() & ~F.isnan("progress"))
    named = knots.select(source_name().alias("source"), F.col("progress").cast("double").alias("progress"), F.col("weight").cast("double").alias("weight"))
    made = named.groupBy("source").applyInPandas(_segments, f"source string, segments {SEGMENTS}")
    return plan.join(made, "source", "left").withColumn("segments", F.coalesce("segments", one))


def position(share_done: Column, segments: Column) -> Column:
    """The progress at which the integrated schedule reaches share_done: its inverse."""
    s = F.get(F.filter(segments, lambda x: x["c1"] >= share_done), F.lit(0))
    rest = share_done - s["c0"]
    root = F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + 2 * s["slope"] * rest))
    # The stable form of the quadratic's root, which holds for a slope of 0 as well.
    step = F.when(s["w0"] + root > 0, 2 * rest / (s["w0"] + root)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["t0"] + step))


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """(source, n_tokens, wanted): how many documents of each size fill a source's gap, the largest first,
    until none fits; then one more if that comes closer. rows: source, gap, n_tokens, n."""
    gap, out = float(rows["gap"].iloc[0]), []
    sizes = sorted(zip(rows["n_tokens"], rows["n"]), reverse=True)
    for size, n in sizes:
        many = min(n, int(gap // size))
        gap -= many * size
        out.append([size, many])
    for k in range(len(sizes) - 1, -1, -1):
        if out[k][1] < sizes[k][1]:  # the smallest of which any is left
            out[k][1] += sizes[k][0] - gap < gap
            break
    return pd.DataFrame([(rows["source"].iloc[0], size, many) for size, many in out if many], columns=["source", "n_tokens", "wanted"])


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, tilt: float = TILT, buckets: int = BUCKETS, planned: DataFrame | None = None, schedules: DataFrame | None = None) -> DataFrame:
    """The draws (position, source, doc_id, repeat_no, n_tokens), sorted by position.

    sizes: doc_id, source, n_tokens; schedules: as with_schedules takes them. Defined results: documents
    without source or tokens, and of sources without a positive weight, are not drawn; no document is drawn
    more than its source's max_repeats times; a source's tokens differ from its demand by no more than half
    its smallest document that is left; without documents or targets there are no rows.
    """
    plan = planned if planned is not None else plan_sources(sizes, targets, total_tokens, tilt)
    # One row per target source, so it may be sent to every task.
    asked = cut(with_schedules(plan, schedules).where(F.col("demand") > 0).select("source", "supply", "demand", "max_repeats", "segments"))
    hashed = sizes.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select("doc_id", "source", "n_tokens", F.xxhash64("doc_id").alias("h"))
    hashed = hashed.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 32), F.lit(buckets)).cast("int"))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    offsets = sums.withColumn("before", before).join(F.broadcast(asked), "source").select("source", "bucket", "before", "supply", "demand", "max_repeats")
    placed = hashed.join(offsets, ["source", "bucket"])
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    rounds = F.floor(F.col("demand") / F.col("supply") + 1e-12)
    placed = placed.withColumn("start", (F.col("before") + inside).cast("double")).withColumns({"rounds": rounds, "part": F.col("demand") - rounds * F.col("supply")})
    placed = cut(placed.select("source", "doc_id", "n_tokens", "h", "start", "supply", "demand", "max_repeats", "rounds", "part"))
    # The last, partial round takes documents in hash order up to the first that doesn't fit; then sizes of
    # the others fill the gap, from a count of each size, which is bounded by the largest document.
    fits = F.col("start") + F.col("n_tokens") <= F.col("part")
    open_ = (F.col("rounds") < F.col("max_repeats")) & (F.col("part") > 0)
    gaps = placed.where(open_).groupBy("source").agg((F.first("part") - F.max(F.when(fits, F.col("start") + F.col("n_tokens")).otherwise(0))).alias("gap"))
    gaps = gaps.where(F.col("gap") > 0)
    over = placed.where(open_ & ~fits).join(F.broadcast(gaps), "source").where(F.col("n_tokens") > F.col("gap")).groupBy("source").agg(F.min("n_tokens").alias("smallest"))
    gaps = cut(gaps.join(over, "source", "left"))
    useful = placed.where(open_ & ~fits).join(F.broadcast(gaps), "source").where((F.col("n_tokens") <= F.col("gap")) | (F.col("n_tokens") == F.col("smallest")))
    counts = useful.groupBy("source", "n_tokens").agg(F.first("gap").alias("gap"), F.count(F.lit(1)).alias("n"))
    wanted = cut(counts.groupBy("source").applyInPandas(_fill, "source string, n_tokens long, wanted long"))
    most = wanted.agg(F.max("wanted")).first()[0] or 0
    nth = F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy("h", "doc_id"))
    chosen = useful.join(wanted, ["source", "n_tokens"]).withColumn("nth", nth).where(F.col("nth") <= most).where(F.col("nth") <= F.col("wanted"))
    by_size = Window.partitionBy("source").orderBy(F.desc("n_tokens"), "h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    late = cut(chosen.select("source", "doc_id", (F.col("part") - F.col("gap") + F.sum("n_tokens").over(by_size) - F.col("n_tokens")).alias("late")))
    placed = placed.join(late, ["source", "doc_id"], "left").join(F.broadcast(asked.select("source", "segments")), "source")
    last = open_ & (fits | F.col("late").isNotNull())
    times = F.least(F.col("rounds") + last.cast("int"), F.col("max_repeats")).cast("int")
    draws = placed.withColumn("times", times).where(F.col("times") > 0).withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("times"))))
    start = F.when(F.col("repeat_no") > F.col("rounds"), F.coalesce("late", "start")).otherwise(F.col("start"))
    middle = (F.col("repeat_no") - 1) * F.col("supply") + start + F.col("n_tokens") / 2
    at = position(F.least(middle / F.col("demand"), F.lit(1.0)), F.col("segments"))
    return draws.select(at.alias("position"), "source", "doc_id", "repeat_no", "n_tokens").orderBy("position", "source", "doc_id", "repeat_no")


def mix_shares(draws: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual shares of the tokens, side by side, with the repeats of each source."""
    got = draws.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_draws"), F.max("repeat_no").alias("most_repeats"))
    rows = plan.join(got, "source", "left").fillna(0, ["tokens", "n_draws", "most_repeats"])
    actual = F.col("tokens") / F.sum("tokens").over(Window.partitionBy())
    return rows.select("source", "target_weight", "target_share", "reachable_share", F.coalesce(actual, F.lit(0.0)).alias("actual_share"), "tokens", "n_documents", "n_draws", "max_repeats", "most_repeats", "tilt")


def _sizes(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    return cut(with_sizes(table(spark, folder, "documents", "doc_id", "source", "text"), tokenizer, copies=False))


def p8_mix(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return mix(_sizes(spark, folder, tokenizer), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    sizes = _sizes(spark, folder, tokenizer)
    plan = cut(plan_sources(sizes, table(spark, folder, "mix_targets")))
    shares = mix_shares(mix(sizes, table(spark, folder, "mix_targets"), planned=plan), plan)
    return shares.select("source", F.round("target_share", 5).alias("target_share"), F.round("reachable_share", 5).alias("reachable_share"), F.round("actual_share", 5).alias("actual_share"), "tokens", "n_documents", "n_draws", "max_repeats", "most_repeats")


def p8_caps(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Sources of mix_targets with whether the mixture keeps to what they allow: only documents of sources with
    a weight are drawn, none oftener than max_repeats, and a source's tokens are within 1 % of its demand, or
    off by no more than half the smallest document that another draw could add."""
    sizes = _sizes(spark, folder, tokenizer)
    plan = cut(plan_sources(sizes, table(spark, folder, "mix_targets")))
    draws = cut(mix(sizes, table(spark, folder, "mix_targets"), planned=plan))
    each = draws.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    shares = mix_shares(draws, plan).join(each.groupBy("source").agg(F.max("n").alias("n")), "source", "left")
    asked = F.broadcast(plan.select("source", "demand", F.floor(F.col("demand") / F.greatest("supply", F.lit(1)) + 1e-12).alias("rounds")))
    left = sizes.where(F.col("n_tokens") > 0).join(asked, "source").join(each, ["source", "doc_id"], "left").where(F.coalesce("n", F.lit(0)) <= F.col("rounds"))
    shares = shares.join(left.groupBy("source").agg(F.min("n_tokens").alias("smallest")), "source", "left").join(asked.drop("rounds"), "source")
    off = F.abs(F.col("tokens") - F.col("demand"))
    within = off <= F.greatest(0.01 * F.col("demand"), 1 + F.coalesce("smallest", F.lit(0)) / 2)
    return shares.select("source", (F.col("n_documents") > 0).alias("has_documents"), (F.coalesce("n", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), within.alias("within_share"))
