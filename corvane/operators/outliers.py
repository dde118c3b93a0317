"""z-scores within datasets, and outliers by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(metric: str) -> Column:
    """The metric as a double, null for NaN."""
    v = F.col(metric).cast("double")
    return F.when(~F.isnan(v), v)


def zscore_outliers(df: DataFrame, key: str, dataset: str, metrics: list[str], limit: float = 3.0) -> DataFrame:
    """key, dataset, max_abs_z, reasons of the rows with |z| > limit in some metric.

    Means and population deviations are aggregated by dataset and joined back; a metric with at most two values,
    or without spread, has no z. NaN is a missing value, like null. Reasons are metric(z=+1.2), in the order of metrics, joined by commas.
    """
    df = df.withColumns({m: known(m) for m in metrics})
    stats = df.groupBy(F.col(dataset).alias("_d")).agg(*[f(m).alias(f"_{n}_{m}") for m in metrics for n, f in (("avg", F.avg), ("std", F.stddev_pop), ("n", F.count))])
    rows = df.join(stats, df[dataset].eqNullSafe(F.col("_d")))
    z = {m: F.when((F.col(f"_n_{m}") > 2) & (F.col(f"_std_{m}") > 0), (F.col(m) - F.col(f"_avg_{m}")) / F.col(f"_std_{m}")) for m in metrics}
    rows = rows.select(key, dataset, *[z[m].alias(f"z_{m}") for m in metrics])
    over = lambda m: F.abs(F.col(f"z_{m}")) > limit
    reason = F.concat_ws(",", *[F.when(over(m), F.format_string(f"{m}(z=%+.1f)", F.col(f"z_{m}"))) for m in metrics])
    worst = F.greatest(*[F.abs(F.col(f"z_{m}")) for m in metrics]) if len(metrics) > 1 else F.abs(F.col(f"z_{metrics[0]}"))
    return rows.where(worst > limit).select(key, dataset, worst.alias("max_abs_z"), reason.alias("reasons"))


def review_upsert(review: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """The review sheet with flagged rows that it lacks; rows already there keep their decisions."""
    new = flagged.join(review.select(key), key, "left_anti")
    return review.unionByName(new, allowMissingColumns=True)
