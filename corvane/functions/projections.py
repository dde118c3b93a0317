"""Projections, filters and checks over tables with columns of any name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_flagged(flags: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first column, in the given order, that is 1 or true; default where none is."""
    return F.coalesce(*[F.when(F.col(c).cast("int") == 1, label) for c, label in flags], F.lit(default))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df, or an error that names the columns it lacks; no job runs."""
    lacking = sorted(set(names) - set(df.columns))
    if lacking:
        raise ValueError(f"columns not found: {', '.join(lacking)}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no row."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def existing(df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """The rows whose path is among files(path)."""
    return df.join(files.select(F.col("path").alias(path)).distinct(), path, "left_semi")


def without(df: DataFrame, key: str, excluded: DataFrame | Sequence) -> DataFrame:
    """The rows whose key is not excluded, null keys included; excluded is a short list or a table that has key."""
    if isinstance(excluded, DataFrame):
        return df.join(excluded.select(key).distinct(), key, "left_anti")
    return df.where(~F.coalesce(F.col(key).isin(list(excluded)), F.lit(False)))


def without_class(df: DataFrame, label: str, name: str, keep: bool = False) -> DataFrame:
    """df without the rows of one class, unless keep."""
    return df if keep else df.where(~F.col(label).eqNullSafe(F.lit(name)))


def merged_ids(c: Column, alias: Mapping[str, str]) -> Column:
    """The id that an alias stands for, one step; other ids stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in alias.items() for x in pair]), c), c) if alias else c


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """All columns but keep under prefix + name."""
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def checked_cast(df: DataFrame, column: str, kind: str, error: str = "load_error") -> DataFrame:
    """column as kind; where a value is no such thing it is null and error tells it, so no row stops the job.

    Messages of several casts add up in error, apart by a semicolon; a row without any has null.
    """
    bad = F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull()
    told = F.when(bad, F.concat(F.lit(f"{column}: no {kind}: "), F.col(column).cast("string")))
    before = F.col(error) if error in df.columns else F.lit(None).cast("string")
    text = F.concat_ws("; ", before, told)
    return df.withColumn(error, F.when(F.length(text) > 0, text)).withColumn(column, F.col(column).try_cast(kind))


def one_slot(branch: Column, value: Column, slots: int) -> tuple[Column, Column]:
    """(slots, presence): arrays with value and true at the place branch (from 0), null and false elsewhere."""
    places = F.sequence(F.lit(0), F.lit(slots - 1))
    return F.transform(places, lambda k: F.when(k == branch, value)), F.transform(places, lambda k: F.coalesce(k == branch, F.lit(False)))


def head_sample(df: DataFrame, order: Sequence[str], n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows by order, and the first max(1, n // 5) of them for validation."""
    return df.orderBy(*order).limit(n), df.orderBy(*order).limit(max(1, n // 5))


def unknown_names(requested: Sequence[str], known: DataFrame, key: str) -> DataFrame:
    """key: requested names that known does not have."""
    asked = known.sparkSession.createDataFrame([(x,) for x in requested], f"{key} string")
    return asked.join(known.select(key), key, "left_anti").distinct()


def selected(df: DataFrame, key: str, category: str, keys: Sequence[str] = (), categories: Sequence[str] = ()) -> DataFrame:
    """Rows of the named keys or categories; all rows where nothing is named. Unknown keys are an error."""
    if not keys and not categories:
        return df
    bad = sorted(r[0] for r in unknown_names(list(keys), df, key).collect()) if keys else []
    if bad:
        raise ValueError(f"unknown {key}: {', '.join(bad)}")
    return df.where(F.col(key).isin(list(keys)) | F.col(category).isin(list(categories)))


def merged_settings(defaults: Column, overrides: Column) -> tuple[Column, Column]:
    """(settings, changed): maps; overrides win, and changed holds those that differ from the default or are new."""
    overrides = F.coalesce(overrides, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(overrides, k))
    return F.map_concat(kept, overrides), F.map_filter(overrides, lambda k, v: ~v.eqNullSafe(F.try_element_at(defaults, k)))


def slices_of(df: DataFrame, key: str, first: str, last: str, name: str = "slice") -> DataFrame:
    """A row for each whole number from first to last; rows without both, or with last before first, give none."""
    return df.where(F.col(first) <= F.col(last)).select("*", F.explode(F.sequence(first, last)).alias(name))


def complete_cases(rows: DataFrame, case: str, phase: str, required: Sequence) -> DataFrame:
    """case: the cases that have every required phase."""
    return rows.where(F.col(phase).isin(list(required))).groupBy(case).agg(F.countDistinct(phase).alias("_n")).where(F.col("_n") == len(set(required))).select(case)


def label_in_name(name: Column, marks: Mapping[str, int]) -> Column:
    """The value of the first mark that the name contains; null where it contains none."""
    return F.coalesce(*[F.when(name.contains(m), v) for m, v in marks.items()], F.lit(None).cast("int"))
