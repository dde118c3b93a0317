"""Grey levels as tables (image, level, n): equalising, matching, windows and fuzzy clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 256


def distribution(levels: DataFrame, image: str, level: str, n: str) -> DataFrame:
    """image, level, n, cdf over the levels that an image has."""
    w = Window.partitionBy(image).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(n).over(Window.partitionBy(image))
    return levels.where(F.col(n) > 0).select(image, level, n, (F.sum(n).over(w) / total).alias("cdf"))


def matched(levels: DataFrame, reference: DataFrame, image: str, level: str, n: str) -> DataFrame:
    """image, level, mapped: the level of the reference (level, n; at most 256 rows) with the same share below it.

    Shares between two of the reference are interpolated, and rounded half to even; matching to its own
    distribution changes nothing.
    """
    target = reference.groupBy(level).agg(F.sum(n).alias("_n")).where("_n > 0")
    curve = target.withColumn("_q", F.sum("_n").over(Window.orderBy(level)) / F.sum("_n").over(Window.partitionBy()))
    points = curve.agg(F.sort_array(F.collect_list(F.struct(F.col("_q").alias("q"), F.col(level).cast("double").alias("v")))).alias("_p"))
    rows = distribution(levels, image, level, n).crossJoin(F.broadcast(points))
    q = F.col("cdf")
    below, above = F.element_at(F.filter("_p", lambda p: p["q"] <= q), -1), F.get(F.filter("_p", lambda p: p["q"] >= q), 0)
    below = F.when(F.exists("_p", lambda p: p["q"] <= q), below)
    value = F.when(below.isNull(), above["v"]).when(above.isNull() | (above["q"] == below["q"]), below["v"]).otherwise(below["v"] + (q - below["q"]) / (above["q"] - below["q"]) * (above["v"] - below["v"]))
    return rows.select(image, level, F.bround(value).cast("int").alias("mapped"))


def equalised(levels: DataFrame, image: str, level: str, n: str) -> DataFrame:
    """image, level, mapped: shares above the darkest level's own, spread over all levels."""
    rows = distribution(levels, image, level, n)
    first = F.min("cdf").over(Window.partitionBy(image))
    return rows.select(image, level, F.coalesce(F.bround((F.col("cdf") - first) / F.nullif(1 - first, F.lit(0.0)) * (LEVELS - 1)), F.col(level)).cast("int").alias("mapped"))


def windowed(levels: DataFrame, image: str, level: str, n: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """image, level, mapped: the span between two shares of the pixels stretched over all levels, the rest clipped.

    Shares are found between the two nearest pixels; where they are equal, levels stay.
    """
    w = Window.partitionBy(image).orderBy(level)
    rows = levels.where(F.col(n) > 0).withColumn("_to", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(n).over(Window.partitionBy(image)))
    rank = lambda p: F.lit(p) * (F.col("_all") - 1)
    at = lambda r: F.min(F.when(F.col("_to") > r, F.col(level)))
    ends = rows.groupBy(image).agg(*[at(f(rank(p))).alias(c) for p, c, f in ((low, "_a", F.floor), (low, "_b", F.ceil), (high, "_c", F.floor), (high, "_d", F.ceil))], F.first("_all").alias("_n"))
    between = lambda p, a, b: F.col(a) + (F.lit(p) * (F.col("_n") - 1) - F.floor(F.lit(p) * (F.col("_n") - 1))) * (F.col(b) - F.col(a))
    ends = ends.select(F.col(image).alias("_i"), between(low, "_a", "_b").alias("_lo"), between(high, "_c", "_d").alias("_hi"))
    scaled = F.least(F.greatest((F.col(level) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(0.0)), F.lit(1.0)) * (LEVELS - 1)
    return rows.join(ends, F.col(image).eqNullSafe(F.col("_i"))).select(image, level, F.when(F.col("_hi") > F.col("_lo"), F.bround(scaled)).otherwise(F.col(level)).cast("int").alias("mapped"))


def fuzzy_clusters(levels: DataFrame, image: str, level: str, n: str, clusters: int = 3, fuzziness: float = 2.0, tolerance: float = 0.005, rounds: int = 1000) -> DataFrame:
    """image, level, cluster (from the darkest), centre, membership: fuzzy c-means over an image's levels, weighted by n.

    An image is a group of at most 256 levels. Centres start at equal shares of its pixels, so results are the same
    every time; rounds end when no membership moves by more than the tolerance.
    """

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        held = frame.groupby(level, as_index=False)[n].sum()
        x, w = held[level].to_numpy(float), held[n].to_numpy(float)
        share = (np.cumsum(w) - w / 2) / w.sum()
        centre = np.interp((np.arange(clusters) + 0.5) / clusters, share, x) + np.arange(clusters) * 1e-6
        was = None
        for _ in range(rounds):
            near = (np.abs(x[None] - centre[:, None]) + 1e-12) ** (-2 / (fuzziness - 1))
            member = near / near.sum(axis=0)
            if was is not None and np.abs(member - was).max() < tolerance:
                break
            was = member
            pull = member**fuzziness * w
            centre = pull @ x / np.maximum(pull.sum(axis=1), 1e-12)
        order = np.argsort(centre)
        return pd.DataFrame({image: frame[image].iloc[0], level: np.tile(held[level].to_numpy(), clusters), "cluster": np.repeat(np.arange(clusters), len(x)), "centre": np.repeat(centre[order], len(x)), "membership": member[order].ravel()})

    types = dict(levels.dtypes)
    return levels.where(F.col(n) > 0).groupBy(image).applyInPandas(fit, f"`{image}` {types[image]}, `{level}` {types[level]}, cluster int, centre double, membership double")


def applied(pixels: DataFrame, table: DataFrame, image: str, level: str) -> DataFrame:
    """pixels with level replaced by what table(image, level, mapped) gives for it."""
    return pixels.join(table, [image, level]).withColumn(level, F.col("mapped")).select(*pixels.columns)
