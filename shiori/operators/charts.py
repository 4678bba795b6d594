"""Chart tables recomputed from data, colours of chart images, static mining of plotting code."""

from __future__ import annotations

import colorsys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks transformations and plots in notebook code, and the literals of images and data files.
TRANSFORMS = ["groupby", ".agg(", ".mean(", ".median(", ".sum(", ".size(", "pivot", "resample", "value_counts", "rolling"]
PLOTS = [".plot(", "sns.", "plt.bar(", "plt.scatter(", "plt.imshow("]
SAVED = r"savefig\s*\(\s*([^\n,]+)"
IMAGE = r"(?i)[\"']([^\"']+\.(?:png|jpe?g|webp|svg))[\"']"
DATA = r"(?i)[\"']([^\"']+\.(?:csv|tsv|xlsx?|json|parquet))[\"']"


def numeric(x: Column) -> Column:
    """x as a number; null where it is none."""
    return x.try_cast("double")


def group_table(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, x, n_rows, mean), sorted by keys and x: rows and mean of y per number x; rows whose x is no number are dropped.

    n_rows counts rows with a null y as well; the mean leaves them out and is null without any value.
    """
    rows = df.withColumn("x", numeric(F.col(x).cast("string"))).where(F.col("x").isNotNull() & ~F.isnan("x"))
    return rows.groupBy(*(keys or []), "x").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(y).cast("double")).alias("mean")).orderBy(*(keys or []), "x")


def is_day_number(x: str) -> Column:
    """Aggregate: every number among the values lies in 1..31, and there is one."""
    n = numeric(F.col(x).cast("string"))
    return (F.count(n) > 0) & F.coalesce(F.min(n) >= 1, F.lit(False)) & F.coalesce(F.max(n) <= 31, F.lit(False))


def points(table: DataFrame, value: str) -> DataFrame:
    """Long form with the status of each point: exact, or unresolved where there is no value."""
    return table.withColumn("y", F.col(value)).withColumn("status", F.when(F.col(value).isNull(), "unresolved").otherwise("exact"))


def assemble(long: DataFrame) -> DataFrame:
    """One row per chart: x values in order, series with their points, and whether every series is complete.

    long: chart_id, series_id, x, y. A chart is bounded by its axis, not by the data it sums up.
    """
    series = long.groupBy("chart_id", "series_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"), F.sum(F.when(F.col("y").isNull(), 1).otherwise(0)).alias("n_unresolved"))
    axis = long.groupBy("chart_id").agg(F.array_sort(F.collect_set("x")).alias("x_values"))
    item = F.struct("series_id", "points")
    chart = series.groupBy("chart_id").agg(F.array_sort(F.collect_list(item)).alias("series"), F.sum("n_unresolved").alias("n_unresolved"), F.max(F.size("points")).alias("most"), F.min(F.size("points")).alias("least"), F.count(F.lit(1)).alias("n_series"))
    whole = (F.col("most") == F.size("x_values")) & (F.col("least") == F.size("x_values")) & (F.col("n_unresolved") == 0)
    return chart.join(axis, "chart_id").select("chart_id", "x_values", "series", "n_series", F.size("x_values").alias("points_per_series"), F.when(whole, "complete").otherwise("partial").alias("completeness"))


def coloured(pixels: DataFrame) -> DataFrame:
    """The pixels (r, g, b) that belong to drawn series rather than to paper, ink or grid."""
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    mean = (F.col("r") + F.col("g") + F.col("b")) / 3
    return pixels.where((high - low >= 40) & ((high - low) / F.greatest(high, F.lit(1)) >= 0.2) & mean.between(35, 245))


def colour_bins(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, qr, qg, qb, n): pixel counts by colour in steps of 32; at most 512 bins per image."""
    step = lambda c: (F.floor(F.col(c) / 32) * 32 + 16).cast("int").alias(f"q{c}")
    return coloured(pixels).groupBy(*(keys or []), step("r"), step("g"), step("b")).agg(F.count(F.lit(1)).alias("n"))


def _hue(r: float, g: float, b: float) -> float:
    return colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)[0] * 360


def merge_hues(bins: list[tuple[int, int, int, int]], min_pixels: int, max_series: int, min_share: float, reach: float = 18.0) -> list[tuple[float, float, float, int]]:
    """Colour clusters (r, g, b, weight), heaviest first: bins by falling count join the first cluster within reach of their hue."""
    clusters: list[list[float]] = []
    for r, g, b, n in sorted(bins, key=lambda x: (-x[3], x[:3])):
        if n < min_pixels:
            break
        hue = _hue(r, g, b)
        for c in clusters:
            apart = abs(c[4] - hue)
            if min(apart, 360 - apart) <= reach:
                total = c[3] + n
                c[:3] = [(old * c[3] + new * n) / total for old, new in zip(c, (r, g, b))]
                c[3], c[4] = total, _hue(*c[:3])
                break
        else:
            clusters.append([r, g, b, n, hue])
    clusters.sort(key=lambda c: -c[3])
    floor = clusters[0][3] * min_share if clusters else 0
    return [(c[0], c[1], c[2], int(c[3])) for c in clusters if c[3] >= floor][:max_series]


def colour_clusters(bins: DataFrame, key: str, min_pixels: int = 24, max_series: int = 6, min_share: float = 0.35) -> DataFrame:
    """(key, cluster_no, r, g, b, weight) of each image's colour bins; ties of equal counts go by colour."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = merge_hues(list(rows[["qr", "qg", "qb", "n"]].itertuples(index=False, name=None)), min_pixels, max_series, min_share)
        return pd.DataFrame([(rows[key].iloc[0], k, *c) for k, c in enumerate(found)], columns=[key, "cluster_no", "r", "g", "b", "weight"])

    return bins.groupBy(key).applyInPandas(run, f"{key} {dict(bins.dtypes)[key]}, cluster_no int, r double, g double, b double, weight long")


def isolated(pixels: DataFrame, clusters: DataFrame, key: str, tolerance: float = 82.0) -> DataFrame:
    """Pixels (key, r, g, b) near the colour of one of the image's clusters, with its number: the views of single series."""
    far = F.sqrt(sum((F.col(f"p.{c}") - F.col(f"c.{c}")) ** 2 for c in "rgb"))
    vivid = F.greatest("p.r", "p.g", "p.b") - F.least("p.r", "p.g", "p.b") >= 25
    return pixels.alias("p").join(clusters.alias("c"), key).where(vivid & (far <= tolerance)).select("p.*", "c.cluster_no")


_NAME = r"[A-Za-z_]\w*"
_TEXT = r"(?:'[^']*'|\"[^\"]*\")"


def unquote(x: Column) -> Column:
    return F.regexp_replace(x, "^['\"]|['\"]$", "")


def mined(cells: DataFrame) -> DataFrame:
    """What notebook cells (path, location, source) say about charts, read from their text only.

    images: literals of savefig calls; data: literals of data files; group_x, group_y, group_label: of
    df.groupby(x).agg(label=(y, 'size')); transforms and plots: the calls that occur.
    """
    src = F.col("source")
    tokens = lambda names: F.filter(F.array(*[F.when(F.contains(src, F.lit(n)), F.lit(n.rstrip("(").lstrip("."))) for n in names]), lambda x: x.isNotNull())
    saves = F.regexp_extract_all(src, F.lit(SAVED), F.lit(1))
    images = F.flatten(F.transform(saves, lambda s: F.slice(F.regexp_extract_all(s, F.lit(IMAGE), F.lit(1)), 1, 1)))
    group = rf"groupby\(\s*({_TEXT}|{_NAME})[^)]*\)\s*\.agg\(\s*({_NAME})\s*=\s*\(\s*({_TEXT}|{_NAME})\s*,\s*['\"]size['\"]"
    part = lambda k: F.nullif(F.regexp_extract(src, group, k), F.lit(""))
    return cells.select(
        "path",
        "location",
        images.alias("images"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(src, F.lit(DATA), F.lit(1)))).alias("data"),
        part(1).alias("group_x"),
        part(3).alias("group_y"),
        part(2).alias("group_label"),
        F.array_sort(tokens(TRANSFORMS)).alias("transforms"),
        F.array_sort(tokens(PLOTS)).alias("plots"),
        F.contains(src, F.lit("groupby")).alias("has_groupby"),
    )


def source_candidates(cells: DataFrame, files: DataFrame) -> DataFrame:
    """(candidate_id, path, location, image, data, image_paths, transforms, plots): where charts come from.

    Data literals count for the whole notebook; an image literal is resolved to the files of its name.
    """
    rows = mined(cells)
    every = rows.groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("data")))).alias("data"))
    each = rows.select("path", "location", F.explode("images").alias("image"), "transforms", "plots").join(every, "path")
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("file")).groupBy("name").agg(F.array_sort(F.collect_set("file")).alias("image_paths"))
    candidate = F.concat(F.lit("cs_"), F.substring(F.sha2(F.concat_ws("\0", "path", "location", "image"), 256), 1, 24))
    joined = each.withColumn("name", F.element_at(F.split("image", "/"), -1)).join(names, "name", "left").drop("name")
    return joined.select(candidate.alias("candidate_id"), *joined.columns).dropDuplicates(["candidate_id"])


# The statements of a notebook from which a chart of counts and means is told.
PATH_SET = r"(\w+)\s*=\s*Path\([\"']([^\"']+)[\"']\)"
TEXT_SET = r"(target_col|date_col_hint)\s*=\s*[\"']([^\"']+)[\"']"
COUNTS = r"agg\s*=\s*tmp\.groupby\((\w+|[\"'][^\"']+[\"'])\)\.agg\(([^=,()]+)=\((\w+|[\"'][^\"']+[\"'])\s*,\s*[\"']size[\"']\)\)"
MEANS = r"agg\[[\"']([^\"']+)[\"']\]\s*=\s*tmp\.groupby\((\w+|[\"'][^\"']+[\"'])\)\[(\w+|[\"'][^\"']+[\"'])\]\.mean\(\)"
PLOTTED = r"ax\w*\.plot\(([^\n]+)\)"
PLOTTED_LABEL = r"agg\[[\"']([^\"']+)[\"']\]"
MARKER, COLOUR = r"marker\s*=\s*[\"']([^\"']+)[\"']", r"color\s*=\s*[\"']([^\"']+)[\"']"
TITLE = r"set_title\(f?[\"']([^\"']+)[\"']\)"


def chart_code(cells: DataFrame) -> DataFrame:
    """Charts of counts and means by group, read from notebook cells (path, location, source) without running them.

    (path, location, x, target, count_label, mean_label, title, styles, data): names given as variables are
    looked up among the notebook's assignments; x may stay null where it can't be. A notebook in which not
    exactly one cell counts by group gives no row. styles: label -> marker and colour of its plot.
    """
    src = F.col("source")
    first = lambda pattern, k: F.nullif(F.regexp_extract(src, pattern, k), F.lit(""))
    pairs = lambda pattern: F.arrays_zip(F.regexp_extract_all(src, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(src, F.lit(pattern), F.lit(2)).alias("v"))
    kept = cells.where(src.isNotNull())
    names = kept.select("path", "location", F.explode(pairs(TEXT_SET)).alias("a"), F.lit("text").alias("kind")).unionByName(kept.select("path", "location", F.explode(pairs(PATH_SET)).alias("a"), F.lit("data").alias("kind")))
    last = names.groupBy("path", "kind", F.col("a.k").alias("k")).agg(F.max_by(F.col("a.v"), F.col("location")).alias("v"))
    known = last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.when(F.col("kind") == "text", F.struct("k", "v")))).alias("texts"), F.array_sort(F.collect_set(F.when((F.col("kind") == "data") & F.col("v").rlike(r"(?i)\.csv$"), F.col("v")))).alias("data"))
    plots = F.transform(F.regexp_extract_all(src, F.lit(PLOTTED), F.lit(1)), lambda a: F.struct(F.regexp_extract(a, PLOTTED_LABEL, 1).alias("label"), F.nullif(F.regexp_extract(a, MARKER, 1), F.lit("")).alias("marker"), F.nullif(F.regexp_extract(a, COLOUR, 1), F.lit("")).alias("colour")))
    found = kept.where(src.rlike(COUNTS)).select("path", "location", first(COUNTS, 1).alias("x_token"), F.trim(first(COUNTS, 2)).alias("count_label"), first(COUNTS, 3).alias("target_token"), first(MEANS, 1).alias("mean_label"), first(TITLE, 1).alias("title"), F.filter(plots, lambda p: p["label"] != "").alias("styles"))
    one = found.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 1).select("path")
    rows = found.join(one, "path", "left_semi").join(known, "path", "left")
    value = lambda token: F.when(F.col(token).rlike("^[\"']"), unquote(F.col(token))).otherwise(F.coalesce(F.element_at("texts", F.col(token)), F.when(F.col(token) == "used_col", F.element_at("texts", F.lit("date_col_hint")))))
    x = value("x_token")
    return rows.select("path", "location", x.alias("x"), value("target_token").alias("target"), "count_label", "mean_label", F.replace(F.col("title"), F.lit("{used_col}"), F.coalesce(x, F.lit("{used_col}"))).alias("title"), "styles", F.coalesce("data", F.array().cast("array<string>")).alias("data"))


def whole_numbers(x: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def chart_records(assembled: DataFrame, sources: DataFrame) -> DataFrame:
    """assemble()'s rows as chart tables: id, type, axes, points with status and completeness checks.

    sources: chart_id, chart_path, chart_sha256, code_path, code_sha256, data_path, data_sha256, x_label, title.
    The id is the hash of the three files, so that any change of theirs makes another chart.
    """
    rows = assembled.join(sources, "chart_id")
    identity = F.sha2(F.concat_ws("\0", "chart_sha256", "code_sha256", "data_sha256"), 256)
    series = F.transform("series", lambda s, k: F.struct(
        F.concat(F.lit("series_"), (k + 1).cast("string")).alias("series_id"), s["series_id"].alias("label"), F.when(k == 0, "y_left").otherwise("y_right").alias("axis_id"),
        F.transform(s["points"], lambda p: F.struct(whole_numbers(p["x"].cast("double")).alias("x"), p["y"].cast("double").alias("y"), F.when(p["y"].isNull(), "unresolved").otherwise("exact").alias("status"))).alias("points")))
    axis = lambda name, label: F.struct(F.lit(name).alias("axis_id"), label.alias("label"))
    labels = F.transform("series", lambda s: s["series_id"])
    axes = F.concat(F.array(axis("x", F.col("x_label")), axis("y_left", F.get(labels, F.lit(0)))), F.when(F.col("n_series") > 1, F.array(axis("y_right", F.get(labels, F.lit(1))))).otherwise(F.array().cast("array<struct<axis_id:string,label:string>>")))
    complete = F.forall("series", lambda s: F.size(s["points"]) == F.size("x_values"))
    return rows.select(
        F.concat(F.lit("ct_"), F.substring(identity, 1, 24)).alias("chart_table_id"),
        F.when(F.col("n_series") > 1, "multi_axis_line").otherwise("line").alias("chart_type"),
        "title",
        axes.alias("axes"),
        F.transform("x_values", lambda x: whole_numbers(x.cast("double"))).alias("x_values"),
        series.alias("series"),
        F.when(complete, "verified").otherwise("partial").alias("status"),
        F.col("n_series").alias("detected_series_count"),
        F.size("series").alias("output_series_count"),
        F.size("x_values").alias("expected_points_per_series"),
        F.struct("chart_path", "chart_sha256", "code_path", "code_sha256", "data_path", "data_sha256").alias("provenance"),
    )
