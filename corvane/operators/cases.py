"""One row to many: what a case holds, as rows of its own, by windows over a case's rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lesion_rows(df: DataFrame, case: str, at: str, area: str) -> DataFrame:
    """case, lesion (from 1), first, last, peak (slice of the largest area, the first of equal ones), total, error.

    A lesion is a stretch of consecutive slices with a positive area; a case without any has no row. A case with a null
    or negative entry, or with a slice twice, is one row with its (first) error and no lesion, and stops no other. A
    case's rows are sorted once, after one shuffle; all is done in the JVM.
    """
    rows = df.select(F.col(case).alias("_case"), F.col(at).cast("long").alias("_at"), F.col(area).cast("double").alias("_area"))
    order, whole = Window.partitionBy("_case").orderBy("_at", "_area"), Window.partitionBy("_case")
    bad = F.when(F.col("_at").isNull() | F.col("_area").isNull() | (F.col("_area") < 0), "slice or area missing or negative")
    bad = bad.when(F.col("_at") == F.lag("_at").over(order), F.concat(F.lit("slice "), F.col("_at").cast("string"), F.lit(" twice")))
    set_ = (F.col("_area") > 0) & ~F.isnan("_area")
    told = rows.withColumn("_bad", bad).withColumn("_set", F.coalesce(set_, F.lit(False))).withColumn("_k", F.col("_at") - F.sum(F.col("_set").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumn("error", F.min(F.when(F.col("_bad").isNotNull(), F.struct("_at", "_area", "_bad"))).over(whole)["_bad"])
    sound = F.col("error").isNull()
    # consecutive slices of positive area differ from their rank among such slices by one number
    held = told.where("error is not null or _set").groupBy("_case", "error", F.when(sound, F.col("_k")).alias("_k")).agg(
        F.min("_at").alias("first"), F.max("_at").alias("last"), F.min_by("_at", F.struct(-F.col("_area"), F.col("_at"))).alias("peak"), F.sum("_area").alias("total")
    )
    number = F.row_number().over(whole.orderBy("first"))
    known = lambda c: F.when(sound, F.col(c)).alias(c)
    return held.select(F.col("_case").alias(case), F.when(sound, number).alias("lesion"), *[known(c) for c in ("first", "last", "peak", "total")], "error")
