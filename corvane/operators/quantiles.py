"""Exact quantiles of whole tables and groups, without a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.graph import cut
from corvane.operators.ranks import sums_before

#: Of the sketch that brackets a rank: it misses by at most n / ACCURACY places.
ACCURACY = 1000
#: Groups whose brackets are sent to every task.
SENT = 10_000


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _picked(rows: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """target columns with lower and upper: what stands at places first and last of each target's rows in order.

    Only values within a target's bracket keep their own; the rest are counted as lying below or above. Counts by
    value are summed in order over range partitions. Null where the place is outside the bracket.
    """
    named = targets.select(*[F.col(k).alias(f"_{k}") for k in keys], "i", "low", "high")
    small = targets.count() <= SENT
    met = rows.join(F.broadcast(named) if small else named, _same(keys, [f"_{k}" for k in keys]))
    side = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
    seen = met.groupBy(*keys, "i", F.struct(side.alias("side"), F.when(side == 0, F.col("v")).alias("v")).alias("o")).agg(F.count("*").alias("n"))
    placed = sums_before(seen, "o", ["n"], [*keys, "i"])
    wanted = targets.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("i").alias("_i"), "first", "last")
    at = placed.join(F.broadcast(wanted) if small else wanted, _same([*keys, "i"], [*[f"_{k}" for k in keys], "_i"]))
    holds = lambda place: (F.col("before_n") <= F.col(place)) & (F.col(place) < F.col("before_n") + F.col("n"))
    return at.groupBy(*keys, "i").agg(F.max(F.when(holds("first"), F.col("o.v"))).alias("lower"), F.max(F.when(holds("last"), F.col("o.v"))).alias("upper"))


def quantiles(df: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """by and, for each name of wanted (column, share from 0 to 1), the exact quantile, interpolated between neighbours.

    A mergeable sketch brackets each wanted place; one more pass counts what lies below a bracket and by value within
    it, and so finds the exact values. A place that its bracket misses is looked for again among all values. Nulls and
    NaN are left out, a column without values gives null, null keys of by are one group, and without by an empty
    table gives a row of nulls.
    """
    by = list(by)
    columns = sorted({c for c, _ in wanted.values()})
    each = F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)])
    keys = [*[f"_at{k}" for k in range(len(by))], "c"]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=False)], F.explode(each).alias("x")).select(*keys[:-1], "x.c", "x.v").where("v is not null and not isnan(v)")
    shares = sorted({p for _, p in wanted.values()})
    ends = [min(1.0, max(0.0, p + s * 2 / ACCURACY)) for p in shares for s in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.percentile_approx("v", F.array(*map(F.lit, ends)), ACCURACY).alias("q"))
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    told = [F.struct(F.lit(i).alias("i"), F.get("q", 2 * i).alias("low"), F.get("q", 2 * i + 1).alias("high"), F.floor(place(p)).alias("first"), F.ceil(place(p)).alias("last"), place(p).alias("place")) for i, p in enumerate(shares)]
    targets = cut(sketch.select(*keys, F.explode(F.array(*told)).alias("t")).select(*keys, "t.*"))
    found = cut(_picked(rows, keys, targets))
    missed = found.where("lower is null or upper is null").select(*[F.col(k).alias(f"m_{k}") for k in [*keys, "i"]])
    if not missed.isEmpty():
        again = targets.join(missed, _same([*keys, "i"], [f"m_{k}" for k in [*keys, "i"]]), "left_semi")
        whole = again.withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("inf")))
        found = found.where("lower is not null and upper is not null").unionByName(_picked(rows, keys, cut(whole)))
    other = targets.select(*[F.col(k).alias(f"t_{k}") for k in [*keys, "i"]], "first", "place")
    valued = found.join(other, _same([*keys, "i"], [f"t_{k}" for k in [*keys, "i"]]))
    between = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise((F.col("first") + 1 - F.col("place")) * F.col("lower") + (F.col("place") - F.col("first")) * F.col("upper"))
    wide = valued.withColumn("value", between).groupBy(*keys[:-1]).agg(
        *[F.max(F.when((F.col("c") == columns.index(c)) & (F.col("i") == shares.index(p)), F.col("value"))).alias(name) for name, (c, p) in wanted.items()]
    )
    if not by:
        return wide
    groups = df.select(*by).distinct()
    return groups.join(wide, _same(by, keys[:-1]), "left").select(*by, *wanted)


def with_quantiles(out: DataFrame, df: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """out (a row for each by) with quantiles() of df."""
    by = list(by)
    found = quantiles(df, by, wanted)
    if not by:
        return out.crossJoin(F.broadcast(found))
    renamed = found.select(*[F.col(b).alias(f"_q{k}") for k, b in enumerate(by)], *wanted)
    return out.join(renamed, _same(by, [f"_q{k}" for k in range(len(by))]), "left").drop(*[f"_q{k}" for k in range(len(by))])
