"""Summaries and report tables over catalogues with columns of any name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.scalar import ratio
from corvane.operators.graph import cut
from corvane.operators.quantiles import quantiles, with_quantiles


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, n for each value of each column, in one pass of grouping sets; a null value stays null."""
    flagged = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(flagged).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """One row: groups, least, middle and most of their rows; null groups are none."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("times"))
    sizes = cut(sizes.withColumn("n", F.col("n").cast("long")))
    whole = sizes.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("groups"), F.min("n").alias("least"), F.max("n").alias("most"))
    return _with_middle(whole, sizes, []).select("groups", "least", "middle", "most")


def _with_middle(out: DataFrame, sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    """out with middle, the median size of sizes(by, n, times): there are few distinct sizes, as their sum is the table's."""
    by = list(by)
    held = sizes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("n", "times"))).alias("x"), F.sum("times").alias("k"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    reach = lambda s, x, place, now: F.when((s["at"] <= place) & (place < s["at"] + x["times"]), x["n"]).otherwise(now)
    lower, upper = F.floor((F.col("k") - 1) / 2), F.floor(F.col("k") / 2)
    middle = F.aggregate("x", start, lambda s, x: F.struct((s["at"] + x["times"]).alias("at"), reach(s, x, lower, s["a"]).alias("a"), reach(s, x, upper, s["b"]).alias("b")), lambda s: (s["a"] + s["b"]) / 2)
    told = held.select(*by, middle.alias("middle"))
    return out.join(told, by, "left") if by else out.crossJoin(F.broadcast(told))


def conditional_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows meet each condition; unknown counts as not met."""
    return df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def any_over(columns: Sequence[str], limit: float) -> Column:
    """Whether one of the columns is over the limit, those that are null aside."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c) > limit, F.lit(False))
    return found


def dataset_summary(df: DataFrame, dataset: str, group: str, used: str, counted: Sequence[str], sizes: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """A row for each dataset: rows, used rows, groups, rows a group (least, middle, most), distinct sizes, flagged rows
    and, as maps, the counts of the values of each counted column. Nothing but group sizes is kept by group."""
    whole = df.groupBy(dataset).agg(
        F.count("*").alias("rows"), F.count_if(F.col(used)).alias("used"), F.countDistinct(F.struct(*sizes)).alias("sizes"),
        *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags],
    )
    per_group = df.where(F.col(group).isNotNull()).groupBy(dataset, group).agg(F.count("*").alias("n"))
    per_size = cut(per_group.groupBy(dataset, "n").agg(F.count("*").alias("times")))
    spread = per_size.groupBy(dataset).agg(F.sum("times").alias("groups"), F.min("n").alias("least"), F.max("n").alias("most"))
    out = whole.join(_with_middle(spread, per_size, [dataset]).select(dataset, "groups", "least", "middle", "most"), dataset, "left")
    for c in counted:
        n = df.groupBy(dataset, F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("v")).agg(F.count("*").alias("n"))
        out = out.join(n.groupBy(dataset).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("v", "n")))).alias(f"{c}_counts")), dataset, "left")
    return out


def case_summary(df: DataFrame, by: Sequence[str], metrics: Sequence[str], flags: Sequence[str], size: str) -> DataFrame:
    """by, n, least/middle/most of each metric, sums of flags, and gigabytes (10^9)."""
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), *[f(m).alias(f"{m}_{s}") for m in metrics for s, f in (("min", F.min), ("max", F.max))],
        *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags], (F.sum(size) / 1e9).alias("gb"),
    )
    told = with_quantiles(out, df, by, {f"{m}_median": (m, 0.5) for m in metrics})
    return told.select(*by, "n", *[f"{m}_{s}" for m in metrics for s in ("min", "median", "max")], *flags, "gb")


def label_table(df: DataFrame, by: str, label: str, values: Mapping[str, object], share: tuple[str, str], middle: Sequence[str] = (), mean: Sequence[str] = ()) -> DataFrame:
    """by, n and a count for each named label value; the first of share over both (null without any), medians and means, to three digits."""
    count = {n: F.count_if(F.col(label) == v) for n, v in values.items()}
    a, b = share
    out = df.groupBy(by).agg(
        F.count("*").alias("n"), *[c.alias(n) for n, c in count.items()], F.round(ratio(count[a], count[a] + count[b]), 3).alias(f"{a}_share"),
        *[F.round(F.avg(c), 3).alias(f"{c}_mean") for c in mean],
    )
    if middle:
        out = with_quantiles(out, df, [by], {f"{c}_median": (c, 0.5) for c in middle})
    return out.select(by, "n", *count, f"{a}_share", *[F.round(f"{c}_median", 3).alias(f"{c}_median") for c in middle], *[f"{c}_mean" for c in mean])


def rollup_scores(df: DataFrame, group: str, unit: str, score: str, label: str) -> DataFrame:
    """group, units, score, label: unit scores are means of their rows; a group has the largest score and label of its units."""
    units = df.groupBy(group, unit).agg(F.avg(score).alias("_s"), F.max(label).alias("_l"))
    return units.groupBy(group).agg(F.count("*").alias("units"), F.max("_s").alias(score), F.max("_l").alias(label))


def mean_scores(df: DataFrame, group: str, score: str, label: str, order: Sequence[str]) -> DataFrame:
    """group, n, score (mean) and the label of the first row by order."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(score).alias(score), F.min_by(label, F.struct(*order)).alias(label))


def mean_and_sample_std(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """by, metric, n, mean, std (of a sample): nulls and NaN are left out; std is null below two values."""
    rows = df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")).alias("v")) for m in metrics])).alias("x"))
    return rows.groupBy(*by, "x.metric").agg(F.count("x.v").alias("n"), F.avg("x.v").alias("mean"), F.stddev_samp("x.v").alias("std"))


def pooled_mean(df: DataFrame, total: str, count: str, by: Sequence[str] = ()) -> DataFrame:
    """by, mean of rows that hold sums and counts."""
    return df.groupBy(*by).agg(ratio(F.sum(total), F.sum(count)).alias("mean"))


def full_histogram(levels: DataFrame, by: str, level: str, n: str, size: int = 256) -> DataFrame:
    """by, level, n for every level from 0 to size - 1 of each by; absent levels have 0."""
    grid = levels.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(level))
    return grid.join(levels.groupBy(by, level).agg(F.sum(n).alias(n)), [by, level], "left").select(by, level, F.coalesce(n, F.lit(0)).cast("long").alias(n))


def accuracy_table(df: DataFrame, pred: str, label: str, source: str, presence: str) -> DataFrame:
    """name, n, accuracy: of each source, of all rows (overall), and of rows with exactly one branch present (single)."""
    hit = F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy")
    one = F.size(F.filter(presence, lambda x: x)) == 1
    each = df.groupBy(F.col(source).alias("name")).agg(F.count("*").alias("n"), hit)
    rest = [df.where(c).agg(F.count("*").alias("n"), hit).select(F.lit(n).alias("name"), "n", "accuracy") for n, c in (("overall", F.lit(True)), ("single", one))]
    return each.union(rest[0]).union(rest[1])


def quartile_text(df: DataFrame, by: Sequence[str], metrics: Sequence[str], digits: int = 1) -> DataFrame:
    """by and, for each metric, the text median [lower quartile, upper quartile]; null where there is no value."""
    text = lambda m: F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", F.col(f"{m}_50"), F.col(f"{m}_25"), F.col(f"{m}_75"))
    found = quantiles(df, by, {f"{m}_{p}": (m, p / 100) for m in metrics for p in (25, 50, 75)})
    return found.select(*by, *[F.when(F.col(f"{m}_50").isNotNull(), text(m)).alias(m) for m in metrics])


def facts(df: DataFrame, named: Mapping[str, Column]) -> DataFrame:
    """name, value of aggregates over the whole table, in one pass."""
    row = df.agg(*[c.cast("double").alias(n) for n, c in named.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in named])).alias("x")).select("x.*")


def density(df: DataFrame, value: str, by: str, low: float, high: float, bins: int = 40) -> DataFrame:
    """by, bin, n, density: equal bins of [low, high], the last closed; shares of a by's values in them, per unit."""
    held = df.where(F.col(value).between(low, high))
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    n = held.groupBy(by, at.alias("bin")).agg(F.count("*").alias("n"))
    total = n.groupBy(by).agg(F.sum("n").alias("_t"))
    return n.join(total, by).select(by, "bin", "n", (F.col("n") / (F.col("_t") * width)).alias("density"))


def log_bins(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n of values within [low, high] over bins of equal ratio."""
    at = F.least(F.floor(F.log(F.col(value) / low) / F.log(F.lit(high / low)) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def grid_counts(df: DataFrame, x: str, y: str, by: Sequence[str] = (), side: int = 20) -> DataFrame:
    """by, gy, gx, n of points in the unit square over side x side cells; points outside are left out."""
    cell = lambda c: F.least(F.floor(F.col(c) * side), F.lit(side - 1)).cast("int")
    return df.where(F.col(x).between(0, 1) & F.col(y).between(0, 1)).groupBy(*by, cell(y).alias("gy"), cell(x).alias("gx")).agg(F.count("*").alias("n"))


def box_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, n, q25, q50, q75 and the whiskers: the last values within one and a half times the quartiles' span."""
    names = ("q25", "q50", "q75")
    q = cut(quantiles(df, by, {n: (value, p) for n, p in zip(names, (0.25, 0.5, 0.75), strict=True)}))
    few = q.select(*[F.col(b).alias(f"_b{k}") for k, b in enumerate(by)], *[F.col(n).alias(f"_{n}") for n in names])
    same = F.lit(True)
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{k}"))
    span, v = 1.5 * (F.col("_q75") - F.col("_q25")), F.col(value)
    return df.join(few, same).groupBy(*by).agg(
        F.count(value).alias("n"), *[F.first(f"_{n}").alias(n) for n in names],
        F.min(F.when(v >= F.col("_q25") - span, v)).alias("low"), F.max(F.when(v <= F.col("_q75") + span, v)).alias("high"),
    )


def mean_image(df: DataFrame, by: Sequence[str], pixels: str) -> DataFrame:
    """by, n, mean, std: arrays over the places of equal-size pixel arrays."""
    places = df.select(*by, F.posexplode(pixels).alias("_i", "_v")).groupBy(*by, "_i").agg(F.count("*").alias("_n"), F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"))
    held = places.groupBy(*by).agg(F.max("_n").alias("n"), F.sort_array(F.collect_list(F.struct("_i", "_m", "_s"))).alias("x"))
    return held.select(*by, "n", F.col("x._m").alias("mean"), F.col("x._s").alias("std"))


def flag_percent(df: DataFrame, by: str, flags: Sequence[str]) -> DataFrame:
    """by, flag, percent of rows that have it; unknown is not."""
    rows = df.select(by, F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.coalesce(F.col(f), F.lit(False)).cast("double").alias("v")) for f in flags])).alias("x"))
    return rows.groupBy(by, "x.flag").agg((100 * F.avg("x.v")).alias("percent"))


def group_rate(df: DataFrame, group: str, label: str, where: Column | None = None) -> DataFrame:
    """One row: groups, positive (those with a row of label 1), rate."""
    held = df if where is None else df.where(where)
    return held.groupBy(group).agg(F.max(label).alias("_l")).agg(F.count("*").alias("groups"), F.sum("_l").alias("positive"), F.avg(F.col("_l").cast("double")).alias("rate"))


def named_splits(df: DataFrame, code: str, others: Mapping[object, str], most: str = "train") -> DataFrame:
    """df with split: the most frequent code (the smallest of equal ones) is most, others by name, the rest null."""
    top = df.groupBy(F.col(code).alias("_c")).agg(F.count("*").alias("_n")).agg(F.min_by("_c", F.struct(-F.col("_n"), F.col("_c"))).alias("_top"))
    named = F.lit(None).cast("string")
    for k, v in others.items():
        named = F.when(F.col(code) == k, v).otherwise(named)
    return df.crossJoin(F.broadcast(top)).withColumn("split", F.when(F.col(code) == F.col("_top"), most).otherwise(named)).drop("_top")


def size_totals(df: DataFrame, by: Sequence[str], size: str) -> DataFrame:
    """by, files, known, total: the total is null unless every size is known."""
    known = F.count(size)
    return df.groupBy(*by).agg(F.count("*").alias("files"), known.alias("known"), F.when(known == F.count("*"), F.sum(size)).alias("total"))


def manifest_counts(df: DataFrame, by: Sequence[str], slices: str, group: str) -> DataFrame:
    """by with subtotals (null for all): lesions (rows), slices (sum) and distinct groups."""
    return df.rollup(*by).agg(F.count("*").alias("lesions"), F.sum(slices).alias("slices"), F.countDistinct(group).alias("groups"))
