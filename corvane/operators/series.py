"""Ordered series by key: patience, averages, curves, evenly spaced places, picks and draws."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.keys import order_key
from corvane.operators.graph import cut
from corvane.operators.ranks import sums_before


def with_patience(df: DataFrame, by: Sequence[str], order: str, metric: str, larger: bool = True, least_change: float = 0.0) -> DataFrame:
    """df with best (so far), improved, and stale: rows since the last improvement. Null metrics never improve."""
    best = F.max if larger else F.min
    w = Window.partitionBy(*by).orderBy(order)
    before = best(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gain = F.col(metric) - before if larger else before - F.col(metric)
    improved = F.col(metric).isNotNull() & F.coalesce(gain > least_change, F.lit(True))
    runs = df.withColumn("improved", improved).withColumn("_run", F.sum(F.col("improved").cast("int")).over(w))
    place = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(order))
    stale = F.when(F.col("_run") == 0, place).otherwise(place - 1)
    return runs.withColumn("best", best(metric).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("stale", stale).drop("_run")


def early_stop(df: DataFrame, by: Sequence[str], order: str, metric: str, patience: int, larger: bool = True) -> DataFrame:
    """by, best_at, best, stop_at: the first order at which the metric has been stale for patience rows, else null; the
    best is that up to there, the first of equal ones."""
    rows = with_patience(df, by, order, metric, larger)
    stops = rows.groupBy(*by).agg(F.min(F.when(F.col("stale") >= patience, F.col(order))).alias("stop_at"))
    held = rows.join(stops, list(by)).where(F.col("stop_at").isNull() | (F.col(order) <= F.col("stop_at"))).where(F.col(metric).isNotNull())
    key = F.struct(F.col(metric) if not larger else -F.col(metric), F.col(order))
    return stops.join(held.groupBy(*by).agg(F.min_by(order, key).alias("best_at"), F.min_by(metric, key).alias("best")), list(by), "left").select(*by, "best_at", "best", "stop_at")


def best_epochs(df: DataFrame, by: Sequence[str], epoch: str, rules: dict[str, bool]) -> DataFrame:
    """by and best_<metric>: the epoch of the largest (rule true) or smallest value of each metric, the first of equal ones."""
    return df.groupBy(*by).agg(*[F.min_by(F.when(F.col(m).isNotNull(), F.col(epoch)), F.when(F.col(m).isNotNull(), F.struct((-F.col(m) if larger else F.col(m)).alias("m"), F.col(epoch)))).alias(f"best_{m}") for m, larger in rules.items()])


def _affine(keep: float, first: bool, values: list) -> tuple[float, float]:
    """(a, b) of the map x -> a x + b that a stretch of values makes of the average before it."""
    a, b = 1.0, 0.0
    for v in values:
        if v is None:
            continue
        a, b = (0.0, v) if first else (a * keep, b * keep + (1 - keep) * v)
        first = False
    return a, b


def moving_average(df: DataFrame, by: Sequence[str], order: str, value: str, keep: float = 0.95) -> DataFrame:
    """by, order, value, ema: keep times the last average and the rest of the value, from the first value on.

    A row is an affine map of the average before it. Rows are dealt by ranges of by and order; each stretch of a series
    within a range is one map, these few are composed in order, and each stretch then starts from what they give: a
    series of any length is never in one place. A null value leaves the average as it is; order is unique within by.
    """
    by = list(by)
    names = [f"_s{k}" for k in range(len(by))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    placed = cut(rows.repartitionByRange(*names, "_o").withColumn("_part", F.spark_partition_id()))
    own, kinds = [*names, "_part"], {f.name: f.dataType.simpleString() for f in placed.schema}
    begins = placed.where("_v is not null").groupBy(*names).agg(F.min("_part").alias("_begin"))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}b"))
    begins = begins.select(*[F.col(n).alias(f"{n}b") for n in names], "_begin")
    # -1 before a series' first value, 0 where it falls, 1 after
    held = placed.join(begins, same, "left").withColumn("_phase", F.coalesce(F.signum(F.col("_part") - F.col("_begin")), F.lit(-1)).cast("int")).select(*own, "_o", "_v", "_phase")

    def compose(table: pa.Table) -> pa.Table:
        part = table.sort_by("_o")
        a, b = _affine(keep, part.column("_phase")[0].as_py() == 0, part.column("_v").to_pylist())
        return pa.table([*[part.column(n).slice(0, 1) for n in own], pa.array([a]), pa.array([b])], names=[*own, "_a", "_b"])

    head = ", ".join(f"{n} {kinds[n]}" for n in own)
    maps = cut(held.groupBy(*own).applyInArrow(compose, f"{head}, _a double, _b double"))
    fold = F.aggregate(F.sort_array(F.collect_list(F.struct("_part", "_a", "_b"))), F.struct(F.lit(0.0).alias("at"), F.array().cast("array<struct<part:int,start:double>>").alias("out")), lambda s, m: F.struct((m["_a"] * s["at"] + m["_b"]).alias("at"), F.array_append(s["out"], F.struct(m["_part"].alias("part"), s["at"].alias("start"))).alias("out")), lambda s: s["out"])  # noqa: E501
    starts = maps.groupBy(*names).agg(fold.alias("_x")).select(*names, F.explode("_x").alias("_y")).select(*names, F.col("_y.part").alias("_part"), F.col("_y.start").alias("_start"))

    def run(table: pa.Table, start: pa.Table) -> pa.Table:
        part, now, out = table.sort_by("_o"), start.column("_start")[0].as_py(), []
        some = part.column("_phase")[0].as_py() == 1
        for v in part.column("_v").to_pylist():
            if v is not None:
                now, some = (now * keep + (1 - keep) * v, True) if some else (v, True)
            out.append(now if some else None)
        return pa.table([*[part.column(n) for n in names], part.column("_o"), part.column("_v"), pa.array(out, pa.float64())], names=[*names, "_o", "_v", "ema"])

    kind = ", ".join(f"{n} {kinds[n]}" for n in [*names, "_o"])
    done = held.groupBy(*own).cogroup(starts.groupBy(*own)).applyInArrow(run, f"{kind}, _v double, ema double")
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], F.col("_o").alias(order), F.col("_v").alias(value), "ema")


def curve_facts(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """by, n, peak_at (place from 0 of the first largest), peak, enhancement (peak over first less 1), washout (peak less
    last over peak); nulls where a curve has fewer than two values, or the divisor is 0."""
    held = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_x")).withColumn("_v", F.col(f"_x.{value}"))
    peak, first, last = F.array_max("_v"), F.get("_v", 0), F.element_at("_v", -1)
    some = F.size("_v") >= 2
    return held.select(*by, F.size("_v").alias("n"), (F.array_position("_v", peak) - 1).cast("int").alias("peak_at"), peak.alias("peak"), F.when(some, F.try_divide(peak - first, first)).alias("enhancement"), F.when(some, F.try_divide(peak - last, peak)).alias("washout"))


def evenly_spaced(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """df with place: k rows of each by at equal distances from first to last, rounded half to even; fewer rows repeat."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.sequence(F.lit(0), F.lit(k - 1))
    at = (lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(k - 1))).cast("int")) if k > 1 else (lambda i: F.lit(0))
    return ranked.withColumn("place", F.explode(F.filter(places, lambda i: at(i) == F.col("_r")))).drop("_r", "_n")


def phase_grid(df: DataFrame, case: str, phase: str, position: str) -> DataFrame:
    """df with phase_no and slice_no, both from 1: phases in their order within a case, positions within a phase."""
    return df.withColumn("phase_no", F.dense_rank().over(Window.partitionBy(case).orderBy(phase))).withColumn("slice_no", F.row_number().over(Window.partitionBy(case, phase).orderBy(position)))


def largest(df: DataFrame, value: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The n rows of the largest absolute value; each task keeps n."""
    return df.where(F.col(value).isNotNull()).orderBy(F.abs(F.col(value)).desc(), *ties).limit(n)


def first_per_group(df: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """The first row of each group by order, of the n first groups."""
    rest = [c for c in df.columns if c != group]
    heads = df.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(group, "_x.*").select(*df.columns)
    return heads.orderBy(group).limit(n)


def subset_in_order(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by hash, in order of their key."""
    return df.orderBy(order_key(seed, key), key).limit(n).orderBy(key)


def errors_per(df: DataFrame, by: Sequence[str], pred: str, label: str, key: str, n: int, seed: int, direction: tuple[int, int] | None = None) -> DataFrame:
    """At most n errors of each by, by hash of their key; direction (label, pred) takes one kind alone."""
    wrong = df.where(F.col(pred) != F.col(label)) if direction is None else df.where((F.col(label) == direction[0]) & (F.col(pred) == direction[1]))
    return wrong.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order_key(seed, key), key))).where(F.col("_k") <= n).drop("_k")


def worst_error(df: DataFrame, by: Sequence[str], prob: str, label: str, key: str, threshold: float = 0.5) -> DataFrame:
    """by and the whole row of the error that was predicted with the most confidence, the smaller key on ties."""
    sure = F.when(F.col(label) == 1, 1 - F.col(prob)).otherwise(F.col(prob))
    wrong = df.where((F.col(prob) >= threshold).cast("int") != F.col(label)).withColumn("confidence", sure)
    rest = [c for c in wrong.columns if c not in by]
    return wrong.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(-F.col("confidence"), F.col(key))).alias("_x")).select(*by, "_x.*")


def weighted_draws(df: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """draw, key: n draws with replacement, each row as likely as its weight.

    Weights are laid end to end in order of the key; draw i is a hash of seed and i, as a place on the whole length,
    and finds its row by a join on coarse pieces of it. Rows of no, null or negative weight are never drawn.
    """
    rows = df.where(F.col(weight) > 0).select(F.col(key).alias("_key"), F.col(weight).cast("double").alias("_w"))
    laid = sums_before(rows, "_key", ["_w"]).select("_key", F.col("before__w").alias("_lo"), (F.col("before__w") + F.col("_w")).alias("_hi"))
    total = rows.agg(F.sum("_w").alias("_t"))
    pieces = F.greatest(F.lit(1.0), F.lit(float(n)))
    piece = lambda c: F.floor(c / F.col("_t") * pieces).cast("long")
    spans = laid.crossJoin(F.broadcast(total)).withColumn("_c", F.explode(F.sequence(piece(F.col("_lo")), piece(F.col("_hi")))))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total)).where("_t is not null")
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    placed = draws.withColumn("_u", unit * F.col("_t")).withColumn("_c", piece(F.col("_u"))).drop("_t")
    return placed.join(spans.select("_key", "_lo", "_hi", "_c"), "_c").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select("draw", F.col("_key").alias(key))
