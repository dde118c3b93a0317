"""Incremental jobs over file streams. Checkpoints and outputs lie in shared folders that the caller names."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming import StreamingQuery


def intake(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark; rows later than that go, so the state stays bounded."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def latest_state(stream: DataFrame, key: str, ts: str, values: list[str]) -> DataFrame:
    """The newest values of each key, for update or complete mode."""
    newest = F.max_by(F.struct(*values), F.struct(ts, *values))
    return stream.groupBy(key).agg(F.max(ts).alias(ts), newest.alias("_x")).select(key, ts, "_x.*")


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, by, n for tumbling windows; a window closes when the watermark passes its end."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), by, "n")


def append_new(stream: DataFrame, key: str, folder: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Rows of the stream whose key the table in folder lacks go there, through build if it is given (the costly part).

    A batch writes into its own subfolder of its query's, and joins away all keys that any other batch of any query
    has written. So a batch that runs again after a failure replaces its own rows alone, and a query with a fresh
    checkpoint over a folder that is in use never touches what is there. Of equal keys in a batch one row is kept.
    """
    told: dict[str, str] = {}
    started = threading.Event()

    def run(batch: DataFrame, number: int) -> None:
        started.wait(120)
        own = f"run={told['id']}/batch={number}"
        new = batch.dropDuplicates([key])
        seen = read_appended(batch.sparkSession, folder)
        if seen is not None:
            new = new.join(seen.where(~F.col("_file").contains(own)).select(key), key, "left_anti").select(*batch.columns)
        (build(new) if build else new).write.mode("overwrite").parquet(f"{folder}/{own}")

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    told["id"] = query.id
    started.set()
    return query


def read_appended(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows that append_new has put in folder, with _file, or None where there are none yet."""
    try:
        return spark.read.option("recursiveFileLookup", True).parquet(folder).withColumn("_file", F.input_file_name())
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def review_queue(stream: DataFrame, key: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Flagged rows of the stream join the review sheet in folder once; rows there, decisions included, stay as they are."""
    return append_new(stream, key, folder, checkpoint)


def read_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """The review sheet."""
    return spark.read.option("recursiveFileLookup", True).parquet(folder)


def watch_patience(stream: DataFrame, run: str, epoch: str, metric: str, patience: int, larger: bool = True) -> DataFrame:
    """run, epoch, metric, best, stale, stop for each row of a metric log, in update mode.

    State is held by run: the best metric so far and for how many epochs it has not improved; stop is true once that
    is patience. Rows of a batch are taken in order of their epoch; null metrics never improve.
    """
    names = [run, epoch, metric]
    types = [stream.schema[c].dataType.simpleString() for c in names]
    out = ", ".join(f"`{c}` {t}" for c, t in zip(names, types, strict=True)) + ", best double, stale int, stop boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, stale = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(epoch)
        told = []
        for e, m in zip(rows[epoch], rows[metric], strict=True):
            better = m == m and m is not None and (best is None or (m > best if larger else m < best))
            best, stale = (float(m), 0) if better else (best, stale + 1)
            told.append((key[0], e, m, best, stale, stale >= patience))
        state.update((best, stale))
        yield pd.DataFrame(told, columns=[*names, "best", "stale", "stop"])

    return stream.select(*names).groupBy(run).applyInPandasWithState(step, out, "best double, stale int", "update", "NoTimeout")
