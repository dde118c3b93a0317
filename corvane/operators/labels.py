"""Labels for segments from clinical findings that are listed by patient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_labels(items: DataFrame, segments: DataFrame, patient: str, ordinal: str, label: str, segment: str, values: list[str], positives_first: bool = True) -> DataFrame:
    """segments with the values of the item at their place, or nulls where a patient's numbers of both differ.

    Items stand in order of ordinal; positives_first puts those with label 1 before the others, else in the order
    they have. Segments stand in order of their number.
    """
    order = ([F.when(F.col(label) == 1, 0).otherwise(1)] if positives_first else []) + [F.col(ordinal)]
    placed = items.select(F.col(patient).alias("_p"), *[F.col(v).alias(f"_{v}") for v in values], F.row_number().over(Window.partitionBy(patient).orderBy(*order)).alias("_k"), F.count("*").over(Window.partitionBy(patient)).alias("_n"))
    asked = segments.withColumn("_at", F.row_number().over(Window.partitionBy(patient).orderBy(segment))).withColumn("_of", F.count("*").over(Window.partitionBy(patient)))
    met = asked.join(placed, (F.col(patient) == F.col("_p")) & (F.col("_at") == F.col("_k")) & (F.col("_of") == F.col("_n")), "left")
    return met.select(*segments.columns, *[F.col(f"_{v}").alias(v) for v in values])


def resolve_labels(items: DataFrame, cases: DataFrame, patient: str, label: str, side: str, case_side: str, guess: str) -> DataFrame:
    """cases with label, label_method and guess_agrees, without relying on the order of segments.

    uniform: all items of the patient share a label. count_mismatch: else, numbers of items and cases differ.
    by_side: else, the items of the case's side share a label. side_conflict: no item lies on that side.
    ambiguous: both labels do. guess_agrees compares with the column guess; null where either is null. Patients
    without items have count_mismatch.
    """
    known = items.where(F.col(label).isNotNull())
    facts = items.groupBy(F.col(patient).alias("_p")).agg(F.countDistinct(label).alias("_labels"), F.min(label).alias("_one"), F.count("*").alias("_items"))
    sides = known.groupBy(F.col(patient).alias("_sp"), F.col(side).alias("_ss")).agg(F.countDistinct(label).alias("_side_labels"), F.min(label).alias("_side_one"))
    counts = cases.groupBy(F.col(patient).alias("_cp")).agg(F.count("*").alias("_cases"))
    met = cases.join(counts, F.col(patient) == F.col("_cp")).join(facts, F.col(patient) == F.col("_p"), "left").join(sides, (F.col(patient) == F.col("_sp")) & (F.col(case_side) == F.col("_ss")), "left")
    method = (
        F.when(F.col("_labels") == 1, "uniform")
        .when(F.coalesce("_items", F.lit(0)) != F.col("_cases"), "count_mismatch")
        .when(F.col("_side_labels") == 1, "by_side")
        .when(F.col("_side_labels").isNull(), "side_conflict")
        .otherwise("ambiguous")
    )
    found = F.when(method == "uniform", F.col("_one")).when(method == "by_side", F.col("_side_one"))
    return met.select(*[c for c in cases.columns if c not in ("label", "label_method", "guess_agrees")], found.alias("label"), method.alias("label_method"), (found == F.col(guess)).alias("guess_agrees"))


def side_agreement(cases: DataFrame, side: str, hypotheses: list[str]) -> DataFrame:
    """hypothesis, n, agrees: the share of cases whose side equals the column of each hypothesis, of those that have both."""
    rows = cases.select(F.explode(F.array(*[F.struct(F.lit(h).alias("hypothesis"), (F.col(h) == F.col(side)).alias("same")) for h in hypotheses])).alias("x"))
    return rows.groupBy("x.hypothesis").agg(F.count("x.same").alias("n"), F.avg(F.col("x.same").cast("double")).alias("agrees"))


def side_of(centre: Column, width: Column, spacing: Column, direction: Column) -> Column:
    """L where a centre lies to the positive half of an image's width along its direction, else R."""
    return F.when((centre - (width - 1) / 2) * spacing * direction > 0, "L").otherwise("R")
