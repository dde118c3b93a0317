"""Cutting lineage through tables in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, which every machine must see.

    Where it is unset, a session whose driver does all the work (local[n], as in tests) gets a temporary folder of
    its own; on a cluster that is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="corvane-"))
    return _own[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet and read back: later jobs start from the files, and survive lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """df, written in buckets of key, as many as a shuffle has partitions, and read back: later groupings by key don't move it.

    The catalogue's name for it goes once it is resolved; the files stay in the shared folder.
    """
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", new_path(spark, label)).saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"drop table {name}")
    return held


@contextmanager
def settings(spark: SparkSession, values: dict) -> Iterator[None]:
    """The session has these settings inside, for work that is done there, and its own again afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
