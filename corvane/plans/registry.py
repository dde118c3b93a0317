"""Collects the query families."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import catalogue, copies, duplicates, evaluation, layouts, masks, pixels, resampling, splits, summaries, tabular

FAMILIES = [catalogue, splits, duplicates, copies, evaluation, tabular, pixels, summaries, resampling, masks, layouts]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
