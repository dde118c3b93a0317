"""Measures of grey images as relations (image, y, x, v): one row a pixel, one group an image."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scalar import ratio


def grid(df: DataFrame, image: str, pixels: Column, width: int, keep: Sequence[str] = ()) -> DataFrame:
    """image, keep, y, x, v of arrays of pixels, line by line; null pixels and images give no rows."""
    rows = df.select(F.col(image).alias("image"), *keep, F.posexplode(pixels).alias("i", "v"))
    return rows.where("v is not null").select("image", *keep, F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def _lines() -> tuple[Window, Window]:
    return Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")


def quality(px: DataFrame, low: float | None = None, high: float | None = None, where: Column | None = None) -> DataFrame:
    """image, brightness, contrast (of a sample), low, high, spread, snr (brightness over contrast); with low and high
    also spread_share of that range and the shares of pixels at or beyond its ends. where limits the pixels."""
    held = px if where is None else px.where(where)
    v = F.col("v")
    ends = [ratio(F.max(v) - F.min(v), F.lit(high - low)).alias("spread_share"), F.avg((v <= low).cast("double")).alias("clipped_low"), F.avg((v >= high).cast("double")).alias("clipped_high")] if low is not None else []
    return held.groupBy("image").agg(F.avg(v).alias("brightness"), F.stddev_samp(v).alias("contrast"), F.min(v).alias("low"), F.max(v).alias("high"), (F.max(v) - F.min(v)).alias("spread"), ratio(F.avg(v), F.stddev_samp(v)).alias("snr"), *ends)


def levels_of(px: DataFrame, low: float, high: float, levels: int = 256) -> DataFrame:
    """image, level (0 to levels - 1, equal steps from low), n; values at high and beyond are of the last level."""
    at = F.greatest(F.least(F.floor((F.col("v") - low) / ((high - low) / levels)), F.lit(levels - 1)), F.lit(0))
    return px.groupBy("image", at.cast("int").alias("level")).agg(F.count("*").alias("n"))


def entropy(levels: DataFrame) -> DataFrame:
    """image, entropy in bits of levels(image, level, n)."""
    n = F.col("n").cast("double")
    return levels.groupBy("image").agg((F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"))


def otsu(levels: DataFrame) -> DataFrame:
    """image, level: the last level of the darker class where both classes differ most (the first of equal ones), from
    running sums over levels(image, level, n)."""
    w = Window.partitionBy("image").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image")
    mass = F.col("n") * F.col("level")
    rows = levels.select("image", "level", F.sum("n").over(w).alias("w0"), F.sum("n").over(whole).alias("w"), F.sum(mass).over(w).alias("s0"), F.sum(mass).over(whole).alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = ratio(F.col("s0"), F.col("w0")) - ratio(F.col("s") - F.col("s0"), w1)
    between = F.col("w0").cast("double") * w1 * gap * gap
    return rows.withColumn("b", between).groupBy("image").agg(F.coalesce(F.max_by("level", F.when(F.col("b").isNotNull(), F.struct("b", -F.col("level")))), F.min("level")).alias("level"))


def sharpness(px: DataFrame) -> DataFrame:
    """image, sharpness: variance of the sum of four neighbours less four times the pixel, the edge repeated."""
    by_x, by_y = _lines()
    near = lambda f, w: F.coalesce(f("v").over(w), F.col("v"))
    lap = near(F.lag, by_x) + near(F.lead, by_x) + near(F.lag, by_y) + near(F.lead, by_y) - 4 * F.col("v")
    return px.withColumn("lap", lap).groupBy("image").agg(F.var_pop("lap").alias("sharpness"))


def noise(px: DataFrame) -> DataFrame:
    """image, sigma: from the mean absolute second difference both ways, over pixels that have all neighbours."""
    by_x, by_y = _lines()
    along = px.withColumn("h", F.lag("v").over(by_x) - 2 * F.col("v") + F.lead("v").over(by_x))
    both = along.withColumn("d", F.lag("h").over(by_y) - 2 * F.col("h") + F.lead("h").over(by_y))
    return both.groupBy("image").agg((F.sqrt(F.lit(math.pi / 2)) * F.avg(F.abs("d")) / 6).alias("sigma")).where("sigma is not null")


def blockiness(px: DataFrame, period: int = 8) -> DataFrame:
    """image, blockiness: the mean step across columns where a block begins over that elsewhere."""
    step = px.withColumn("g", F.abs(F.col("v") - F.lag("v").over(_lines()[0])))
    edge = F.col("x") % period == 0
    return step.where("g is not null").groupBy("image").agg(ratio(F.avg(F.when(edge, F.col("g"))), F.avg(F.when(~edge, F.col("g")))).alias("blockiness"))


def tiles(px: DataFrame, side: int, least: int = 1) -> DataFrame:
    """image, ty, tx, snr (mean over deviation) of tiles of at least least pixels."""
    at = lambda c: F.floor(F.col(c) / side).cast("int").alias(f"t{c}")
    out = px.groupBy("image", at("y"), at("x")).agg(F.count("*").alias("n"), ratio(F.avg("v"), F.stddev_pop("v")).alias("snr"))
    return out.where(F.col("n") >= least).select("image", "ty", "tx", "snr")


def speckle(tiled: DataFrame, least: int = 5) -> DataFrame:
    """image, snr: the median of the upper half of tiles(); images of fewer than least tiles have null."""
    held = tiled.where("snr is not null").groupBy("image").agg(F.sort_array(F.collect_list("snr")).alias("s"), F.count("*").alias("n"))
    upper = F.slice("s", F.floor(F.col("n") / 2).cast("int") + 1, F.col("n").cast("int"))
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    return held.select("image", F.when(F.col("n") >= least, middle(upper)).alias("snr"))


def block_means(px: DataFrame, side: int) -> DataFrame:
    """image, y, x, v: means of blocks of side x side pixels."""
    at = lambda c: F.floor(F.col(c) / side).cast("int").alias(c)
    return px.groupBy("image", at("y"), at("x")).agg(F.avg("v").alias("v"))


def _pixel_quantile(values: str, p: float) -> Column:
    """Of a sorted array, interpolated; an image's pixels are one array."""
    place = F.lit(p) * (F.size(values) - 1)
    low, high = F.get(values, F.floor(place).cast("int")), F.get(values, F.ceil(place).cast("int"))
    return low + (place - F.floor(place)) * (high - low)


def window_scaled(px: DataFrame, low: float, high: float, positive: bool = False) -> DataFrame:
    """px with v between the quantiles low and high of its image, from 0 to 1, clipped; positive takes quantiles of
    positive pixels alone. Null where both are equal or there are none."""
    held = px.where("v > 0") if positive else px
    ends = held.groupBy("image").agg(F.sort_array(F.collect_list("v")).alias("s")).select(F.col("image").alias("_i"), _pixel_quantile("s", low).alias("a"), _pixel_quantile("s", high).alias("b"))
    met = px.join(ends, F.col("image").eqNullSafe(F.col("_i")), "left")
    return met.withColumn("v", F.least(F.greatest(ratio(F.col("v") - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0)), F.lit(1.0))).withColumn("v", F.when(F.col("b") > F.col("a"), F.col("v"))).select(*px.columns)


def z_normed(px: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """px with v less the mean over the deviation of its image; with low and high, of the values strictly between."""
    inside = px if low is None else px.where((F.col("v") > low) & (F.col("v") < high))
    facts = inside.groupBy("image").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).withColumnRenamed("image", "_i")
    return px.join(facts, F.col("image").eqNullSafe(F.col("_i")), "left").withColumn("v", ratio(F.col("v") - F.col("m"), F.col("s"))).select(*px.columns)


def cropped(px: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Pixels of a box (ends exclusive), counted from its corner."""
    return px.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)).withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0)


def set_box(px: DataFrame, where: Column) -> DataFrame:
    """image, x0, y0, x1, y1 (inclusive), area, cx, cy of the pixels that meet a condition."""
    return px.where(where).groupBy("image").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def mean_image(px: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, y, x, mean, std, top over images."""
    return px.groupBy(*by, "y", "x").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max("v").alias("top"))


def column_profile(px: DataFrame) -> DataFrame:
    """image, x, mean of each column."""
    return px.groupBy("image", "x").agg(F.avg("v").alias("mean"))


def dual_panel(profile: DataFrame, width: int, dark: float = 0.02, content: float = 0.3) -> DataFrame:
    """image, dual_panel: a column below dark in the middle (from 0.3 to 0.7 of the width), and one above content on each side, of column_profile()."""
    left, right = int(0.3 * width), int(0.7 * width)
    inside, m = F.col("x").between(left, right - 1), F.col("mean")
    side = lambda c: F.coalesce(F.max(F.when(c, m)) > content, F.lit(False))
    return profile.groupBy("image").agg((F.coalesce(F.min(F.when(inside, m)) < dark, F.lit(False)) & side(F.col("x") < left) & side(F.col("x") >= right)).alias("dual_panel"))


def beside(px: DataFrame, where: Column) -> DataFrame:
    """px with set, whether a pixel meets a condition, and around, how many of its four neighbours do."""
    by_x, by_y = _lines()
    held = px.withColumn("set", where)
    near = lambda f, w: F.coalesce(f("set").over(w), F.lit(False)).cast("int")
    return held.withColumn("around", near(F.lag, by_x) + near(F.lead, by_x) + near(F.lag, by_y) + near(F.lead, by_y))


def ring_contrast(px: DataFrame, where: Column) -> DataFrame:
    """image, cnr: how far the means of what is set and of the pixels beside it are apart, in deviations of the latter."""
    m, r = F.when(F.col("set"), F.col("v")), F.when(~F.col("set"), F.col("v"))
    return beside(px, where).where("set or around > 0").groupBy("image").agg(ratio(F.abs(F.avg(m) - F.avg(r)), F.stddev_pop(r)).alias("cnr"))


def kinetic_curve(px: DataFrame, phase: Column, where: Column) -> DataFrame:
    """image, phase, mean, peak of the pixels that meet a condition."""
    return px.where(where).groupBy("image", phase.alias("phase")).agg(F.avg("v").alias("mean"), F.max("v").alias("peak"))


def volume_facts(px: DataFrame, case: str, where: Column, voxel_ml: float) -> DataFrame:
    """case, voxels, slices (images with a set pixel), x0, x1, width, cx, cy and ml of the set pixels of a case's images."""
    return px.where(where).groupBy(case).agg(F.count("*").alias("voxels"), F.countDistinct("image").alias("slices"), F.min("x").alias("x0"), F.max("x").alias("x1"), (F.max("x") - F.min("x") + 1).alias("width"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.count("*") * F.lit(voxel_ml)).alias("ml"))


def whole_similarity(a: DataFrame, b: DataFrame, c1: float, c2: float) -> DataFrame:
    """image, ssim over whole images of two relations that share image, y and x."""
    both = a.join(b.select("image", "y", "x", F.col("v").alias("w")), ["image", "y", "x"])
    g = both.groupBy("image").agg(F.avg("v").alias("ma"), F.avg("w").alias("mb"), F.var_pop("v").alias("va"), F.var_pop("w").alias("vb"), F.covar_pop("v", "w").alias("c"))
    return g.select("image", ((2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("c") + c2) / ((F.col("ma") ** 2 + F.col("mb") ** 2 + c1) * (F.col("va") + F.col("vb") + c2))).alias("ssim"))


def central_lines(px: DataFrame, where: Column, least: int = 4, reach: int = 1) -> DataFrame:
    """image, y of the lines (or slices) with at least least set pixels, the middle one and reach on either side."""
    held = px.where(where).groupBy("image", "y").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy("image")
    placed = held.withColumn("r", F.row_number().over(w.orderBy("y")) - 1).withColumn("k", F.count("*").over(w))
    return placed.where(F.abs(F.col("r") - F.floor(F.col("k") / 2)) <= reach).select("image", "y")
