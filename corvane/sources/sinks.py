"""Writing tables, reports and manifests. Every sink writes with Spark, into a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "binary")


def plain_columns(df: DataFrame) -> DataFrame:
    """Columns of nested types as JSON text, null where they are null; others stay."""
    return df.select(*[F.col(c) if t in PLAIN or t.startswith("decimal") else F.to_json(c).alias(c) for c, t in df.dtypes])


def write_table(df: DataFrame, path: str) -> None:
    """Parquet of plain columns, in place of what is there."""
    plain_columns(df).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON."""
    plain_columns(df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row; null fields are written as null."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def cell(c: Column, kind: str, digits: int = 3) -> Column:
    """A report cell: thousands with commas, fractions with digits, -- for null."""
    text = F.format_number(c, 0) if kind in ("tinyint", "smallint", "int", "bigint") else F.format_number(c, digits) if kind in ("float", "double") else c.cast("string")
    return F.coalesce(text, F.lit("--"))


def report_lines(df: DataFrame, digits: int = 3) -> DataFrame:
    """line: the cells of each row between ampersands, as tables of typeset reports have them."""
    return df.select(F.concat(F.concat_ws(" & ", *[cell(F.col(c), t, digits) for c, t in df.dtypes]), F.lit(r" \\")).alias("line"))


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """The column line as text. With order, sorted by those columns, as a report of bounded size is; one file then."""
    held = lines.orderBy(*order).coalesce(1) if order else lines
    held.select("line").write.mode("overwrite").text(path)


def status_report(inventory: DataFrame, state: DataFrame, key: str, category: str, position: str, title: str, notes: str) -> DataFrame:
    """category, position, line: a Markdown row for each entry of the inventory with its state.

    state has key, status and detail. An entry without state is pending and shows its notes. The first entry of a
    category follows the category's heading, which has position -1.
    """
    held = inventory.join(state.select(key, "status", "detail"), key, "left")
    row = F.format_string("| %s | %s | %s |", F.coalesce(F.col(title), F.lit("--")), F.coalesce("status", F.lit("pending")), F.coalesce("detail", F.col(notes), F.lit("")))
    rows = held.select(F.col(category).alias("category"), F.col(position).cast("long").alias("position"), row.alias("line"))
    heads = rows.select("category").distinct().select("category", F.lit(-1).cast("long").alias("position"), F.concat(F.lit("## "), "category").alias("line"))
    return heads.union(rows)


def write_split_tree(df: DataFrame, path: str, split: str = "split", label: str = "label", group: str | None = None) -> None:
    """Parquet under split=.../label=.../[group=...]; rows of a folder come from few tasks."""
    keys = [split, label, *([group] if group else [])]
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_checksums(manifest: DataFrame, path: str) -> None:
    """digest, two blanks, path in a line, in order of the paths."""
    manifest.select(F.concat_ws("  ", "digest", "path").alias("line"), "path").orderBy("path").select("line").write.mode("overwrite").text(path)


def slot_manifest(images: DataFrame, labels: dict[str, int], slots: int = 3, slot: int = 0) -> DataFrame:
    """img1.., label: class-folder rows (path, label) in one of the slots, MISSING in the others, labels by name.

    Classes without a number go. No image at all is an error.
    """
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    held = images.withColumn("_n", F.try_element_at(names, F.col("label"))).where("_n is not null")
    if held.isEmpty():
        raise ValueError("no image has one of the labels")
    return held.select(*[(F.col("path") if k == slot else F.lit("MISSING")).alias(f"img{k + 1}") for k in range(slots)], F.col("_n").alias("label"))
