"""Ranks over whole tables without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.graph import cut

PREFIX = 3  # hex digits: 4,096 buckets of about equal size


def ranked(df: DataFrame, key: str, by: list[str] | None = None, tie: str | None = None, rank: str = "rank", total: str = "total") -> DataFrame:
    """Adds the rank from 0 by the hex key (ties by the column tie) within by, and the number of rows there.

    Rows are sorted within buckets of the key's first digits; only bucket counts, at most 4,096 for each value
    of by, are accumulated in order. Null values of by are one group.
    """
    by = by or []
    df = df.withColumn("_b", F.substring(key, 1, PREFIX))
    counts = df.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    span = Window.partitionBy(*by)
    before = counts.withColumn("_before", F.sum("_n").over(span.orderBy("_b")) - F.col("_n")).withColumn(total, F.sum("_n").over(span)).drop("_n")
    names = [f"_{k}" for k in range(len(by))]
    for c, n in zip(by, names, strict=True):
        before = before.withColumnRenamed(c, n)
    before = before.withColumnRenamed("_b", "_bucket")
    same = F.col("_b") == F.col("_bucket")
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    inner = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(key, *([tie] if tie else []))) - 1
    return df.withColumn("_inner", inner).join(before, same).withColumn(rank, (F.col("_before") + F.col("_inner")).cast("long")).drop("_b", "_bucket", "_inner", "_before", *names)


def sums_before(df: DataFrame, order: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """df with before_<column>: the sum over the rows of by whose order is smaller; order is unique within by.

    Rows are range-partitioned by order; sums of whole partitions are accumulated in a table of one row each, and
    rows only within their partition, so no task orders them all.
    """
    by = by or []
    placed = cut(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))
    whole = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(c) for c in columns])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_by{k}" for k in range(len(by))]
    parts = whole.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("_part").alias("_own_part"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_e_{c}") for c in columns])
    inner = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = placed.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_i_{c}") for c in columns])
    same = F.col("_part") == F.col("_own_part")
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return held.join(parts, same).select(*df.columns, *[(F.col(f"_e_{c}") + F.col(f"_i_{c}")).alias(f"before_{c}") for c in columns])
