"""Reading tables and text records."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def files_under(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """path, length, modified of the files under root, by suffix (any case) if any is given; contents are never read.

    Empty files are files; folders, whatever their names, and symbolic links are none; a root that does not exist gives
    no rows. The names are listed by the driver, as Spark's own readers do.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    if store.exists(top):
        walk = store.listFiles(top, True)
        while walk.hasNext():
            status = walk.next()
            path = status.getPath().toString()
            local = path.removeprefix("file:") if path.startswith("file:") else None
            if not (status.isSymlink() or local and os.path.islink(local)):
                rows.append((path, status.getLen(), status.getModificationTime()))
    files = spark.createDataFrame(rows, "path string, length long, modified long").select("path", "length", F.timestamp_millis("modified").alias("modified"))
    if suffixes:
        match = F.lit(False)
        for x in suffixes:
            match = match | F.lower("path").endswith(x.lower())
        files = files.where(match)
    return files


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def class_folders(files: DataFrame) -> DataFrame:
    """Adds label (parent folder), name and stem; files whose name contains mask are left out."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.select("*", F.element_at(parts, -2).alias("label"), name.alias("name"), _stem(name).alias("stem")).where(~F.lower("name").contains("mask"))


def masks_of(files: DataFrame) -> DataFrame:
    """label, stem, masks: how many files named stem_mask... stand beside each image."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    held = files.select(F.element_at(parts, -2).alias("label"), F.regexp_extract(name, r"(?i)^(.*?)_mask", 1).alias("stem"))
    return held.where("stem <> ''").groupBy("label", "stem").agg(F.count("*").alias("masks"))


def paired_images(files: DataFrame) -> DataFrame:
    """class_folders() rows that have a mask beside them, with the number of masks."""
    return class_folders(files).join(masks_of(files), ["label", "stem"])


def path_parts(files: DataFrame, names: tuple[str, ...], suffix: str = "") -> DataFrame:
    """The last folders of each path under names, then stem: root/split/class/patient/x.npy by ("split", "class", "patient")."""
    parts = F.split("path", "/")
    held = files.where(F.lower("path").endswith(suffix.lower())) if suffix else files
    return held.where(F.size(parts) > len(names)).select("path", *[F.element_at(parts, k - len(names) - 1).alias(n) for k, n in enumerate(names)], _stem(F.element_at(parts, -1)).alias("stem"))


def numbered_files(files: DataFrame, pattern: str) -> DataFrame:
    """folder, path, number, place, of: the files of a folder in order of the number that pattern's group finds in their name."""
    name = F.element_at(F.split("path", "/"), -1)
    held = files.where(name.rlike(pattern)).select(F.element_at(F.split("path", "/"), -2).alias("folder"), "path", F.regexp_extract(name, pattern, 1).cast("int").alias("number"))
    in_order = Window.partitionBy("folder").orderBy("number", "path")
    return held.select("*", F.row_number().over(in_order).alias("place"), F.count("*").over(Window.partitionBy("folder")).alias("of"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, read by name with the given types; values that don't fit are null."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def sheet(spark: SparkSession, path: str, header_row: int = 0) -> DataFrame:
    """A sheet landed as CSV whose names stand in row header_row (from 0); rows before it go, blank rows too."""
    rows = spark.read.option("header", False).csv(path)
    lines = rows.select(F.array(*rows.columns).alias("v"), F.monotonically_increasing_id().alias("at"))
    names = [n.strip() if n and n.strip() else f"column{k}" for k, n in enumerate(lines.where(F.col("at") == header_row).first()["v"])]
    held = lines.where((F.col("at") > header_row) & F.exists("v", lambda x: F.length(F.trim(F.coalesce(x, F.lit("")))) > 0))
    return held.select(*[F.trim(F.get("v", k)).alias(n) for k, n in enumerate(names)])


def records(spark: SparkSession, path: str, names: tuple[str, ...], least: int = 1) -> DataFrame:
    """Lines of values between blanks under names; missing last values are null, lines of fewer than least go, more values are left."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where((F.length(F.trim("value")) > 0) & (F.size(parts) >= least))
    return lines.select(*[F.get(parts, k).alias(n) for k, n in enumerate(names)])


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id: the words of a text file, in any layout, each once."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("id")).where("id <> ''").distinct()


def registry(spark: SparkSession, path: str, entry_schema: str) -> DataFrame:
    """name and the fields of each entry of a registry landed as one JSON map, in order of their names."""
    return json_map(spark, path, entry_schema).select(F.col("key").alias("name"), "value.*").orderBy("name")


def validity(df: DataFrame, key: list[str], columns: list[str], counted: list[str], name: str = "n_valid") -> DataFrame:
    """key, has_<column> for each of columns, and how many of counted are not null; no value is read further."""
    return df.select(*key, *[F.col(c).isNotNull().alias(f"has_{c}") for c in columns], sum((F.col(c).isNotNull().cast("int") for c in counted), F.lit(0)).alias(name))


def predictions(spark: SparkSession, root: str, runs: list[str], folds: list[int], schema: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Rows of root/run=.../fold=... with run and fold, and the (run, fold) that are not there; one scan for all of them."""
    jvm = spark.sparkContext._jvm
    place = lambda run, fold: f"{root}/run={run}/fold={fold}"
    there = lambda path: (p := jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    asked = [(r, k) for r in runs for k in folds]
    held = [x for x in asked if there(place(*x))]
    if not held:
        return spark.createDataFrame([], f"{schema}, run string, fold int"), asked
    found = spark.read.schema(f"{schema}, run string, fold int").option("basePath", root).parquet(*[place(*x) for x in held])
    return found, [x for x in asked if x not in set(held)]


def run_results(spark: SparkSession, path: str, fold_schema: str) -> DataFrame:
    """fold (from 1) and the metrics of each entry of per_fold in one run's JSON."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"struct<per_fold:array<{fold_schema}>>")["per_fold"]).alias("at", "m")).select((F.col("at") + 1).alias("fold"), "m.*")


def semicolon_csv(spark: SparkSession, path: str) -> DataFrame:
    """A ;-separated CSV with header; a byte-order mark before the first name and blanks around values go."""
    df = spark.read.option("header", True).option("sep", ";").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.select(*[F.trim(c).alias(c) for c in df.columns])


def checksum_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, digest from lines of digest, two blanks, path."""
    parts = F.split("value", "  ", 2)
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.get(parts, 1).alias("path"), F.get(parts, 0).alias("digest"))


def json_map(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """key, value for each entry of one JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("key", "value"))


def job_log(spark: SparkSession, path: str) -> DataFrame:
    """ts, event, command of lines: time START|EXIT command."""
    pattern = r"^(\S+ \S+) (START|EXIT) (.*)$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(F.to_timestamp(F.regexp_extract("value", pattern, 1)).alias("ts"), F.regexp_extract("value", pattern, 2).alias("event"), F.regexp_extract("value", pattern, 3).alias("command"))


def job_durations(log: DataFrame) -> DataFrame:
    """command, started, seconds of each start in a job log; null seconds where no exit of the command follows."""
    order = Window.partitionBy("command").orderBy("ts", F.col("event") == "START")
    nxt = log.withColumn("_e", F.lead("event").over(order)).withColumn("_t", F.lead("ts").over(order))
    seconds = F.when(F.col("_e") == "EXIT", F.unix_timestamp("_t") - F.unix_timestamp("ts"))
    return nxt.where("event = 'START'").select("command", F.col("ts").alias("started"), seconds.alias("seconds"))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; only where there is none, build() is written there first. Other failures are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if not _absent(e):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)
