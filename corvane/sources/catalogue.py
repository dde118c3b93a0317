"""Catalogues of samples from specs: one schema for every source, no code per source."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["sample_id", "dataset", "grp", "label_name", "label", "used", "split"]


@dataclass(frozen=True)
class Spec:
    """How a table's columns become a sample. Values are SQL expressions over the table.

    labels maps label names (trimmed, lower case) to 0 or 1; other names have no label. keep filters rows; once
    gives the order by which the first row of an id is kept, where ids repeat.
    """

    dataset: str
    sample_id: str
    group: str
    label_name: str
    labels: Mapping[str, int]
    keep: str = "true"
    split: str = "cast(null as string)"
    once: tuple[str, ...] = field(default=())


def mapped_label(name: Column, labels: Mapping[str, int]) -> Column:
    """0, 1 or null by the trimmed lower-case name."""
    found = F.lit(None).cast("int")
    for key, value in labels.items():
        found = F.when(F.lower(F.trim(name)) == key, value).otherwise(found)
    return found


def build_catalogue(df: DataFrame, spec: Spec) -> DataFrame:
    """The samples of one source in COLUMNS; used tells rows with a label. Null ids go; an empty table gives none."""
    name = F.expr(spec.label_name).cast("string")
    label = mapped_label(name, spec.labels)
    rows = df.where(F.expr(spec.keep)).select(F.expr(spec.sample_id).cast("string").alias("sample_id"), F.expr(spec.group).cast("string").alias("grp"), name.alias("label_name"), label.alias("label"), F.expr(spec.split).alias("split"), *[F.expr(o).alias(f"_o{k}") for k, o in enumerate(spec.once)])
    rows = rows.where("sample_id is not null")
    if spec.once:
        whole = F.struct("grp", "label_name", "label", "split")
        order = F.struct(*[f"_o{k}" for k in range(len(spec.once))])
        rows = rows.groupBy("sample_id").agg(F.min_by(whole, order).alias("x")).select("sample_id", "x.*")
    return rows.withColumn("dataset", F.lit(spec.dataset)).withColumn("used", F.col("label").isNotNull()).select(*COLUMNS)


def union_catalogues(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
