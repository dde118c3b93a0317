"""Streams over files, read to their end, restarted, and started afresh."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import steps
from corvane.streaming import jobs


def put(spark, source, rows, schema="id long, reason string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)


def test_review_queue_keeps_what_it_has(spark, tmp_path):
    source, folder, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    stream = lambda: spark.readStream.schema("id long, reason string").parquet(source)
    held = lambda: sorted((r.id, r.reason) for r in jobs.read_reviews(spark, folder).collect())
    put(spark, source, [(1, "a"), (2, "b"), (2, "b")])
    jobs.review_queue(stream(), "id", folder, mark).awaitTermination(120)
    put(spark, source, [(2, "again"), (3, "c")])
    jobs.review_queue(stream(), "id", folder, mark).awaitTermination(120)
    assert held() == [(1, "a"), (2, "b"), (3, "c")]
    # a decision is recorded beside the queue's own rows, and a fresh checkpoint reads everything again
    spark.createDataFrame([(9, "decided")], "id long, reason string").coalesce(1).write.parquet(f"{folder}/by_hand")
    put(spark, source, [(9, "x"), (4, "d")])
    jobs.review_queue(stream(), "id", folder, str(tmp_path / "fresh")).awaitTermination(120)
    assert held() == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (9, "decided")]


def test_only_new_rows_are_built(spark, tmp_path):
    source, folder, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    built = []

    def profile(df):
        built.extend(r.id for r in df.collect())
        return df.withColumn("twice", F.col("id") * 2)

    for rows, checkpoint in (([(1, "a")], mark), ([(1, "a"), (2, "b")], mark), ([(2, "b"), (3, "c")], str(tmp_path / "fresh"))):
        put(spark, source, rows)
        jobs.append_new(spark.readStream.schema("id long, reason string").parquet(source), "id", folder, checkpoint, profile).awaitTermination(120)
    assert sorted(built) == [1, 2, 3]
    assert sorted((r.id, r.twice) for r in jobs.read_appended(spark, folder).collect()) == [(1, 2), (2, 4), (3, 6)]


def test_patience_over_restarts(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "run string, epoch long, auc double"
    for rows in ([("a", 1, 0.5), ("a", 2, 0.7), ("b", 1, None)], [("a", 3, 0.6), ("a", 4, 0.7), ("b", 2, 0.1)]):
        put(spark, source, rows, schema)
        watched = jobs.watch_patience(spark.readStream.schema(schema).parquet(source), "run", "epoch", "auc", 2)
        keep = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}")
        watched.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(180)
    got = {(r.run, r.epoch): (r.best, r.stale, r.stop) for r in spark.read.option("recursiveFileLookup", True).parquet(out).collect()}
    assert got == {("a", 1): (0.5, 0, False), ("a", 2): (0.7, 0, False), ("a", 3): (0.7, 1, False), ("a", 4): (0.7, 2, True), ("b", 1): (None, 1, False), ("b", 2): (0.1, 0, False)}


def test_latest_state_intake_and_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:00:00", "x"), (1, "2024-01-01 00:05:00", "y"), (2, "2024-01-01 00:01:00", "z")]
    spark.createDataFrame(rows, "id long, t string, v string").select("id", F.to_timestamp("t").alias("ts"), "v").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id long, ts timestamp, v string").parquet(source)
    for name, df, mode in (("latest", jobs.latest_state(stream, "id", "ts", ["v"]).select("id", "v"), "complete"), ("first", jobs.intake(stream, "id", "ts").select("id"), "append"), ("windows", jobs.windowed_counts(stream, "ts", "id", "1 hour"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("latest").collect()) == [(1, "y"), (2, "z")]
    assert sorted(r.id for r in spark.table("first").collect()) == [1, 2]
    assert sorted((r.id, r.n) for r in spark.table("windows").collect()) == [(1, 2), (2, 1)]


def test_steps(spark, tmp_path):
    calls = []

    @steps.step("scale")
    def scale(df, by="1", column="v"):
        calls.append(by)
        return df.withColumn(column, F.col(column) * int(by))

    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert steps.parse("scale: by=3 ;column=v") == ("scale", {"by": "3", "column": "v"})
    assert sorted(r.v for r in steps.apply(df, ["scale:by=3", "scale:by=2"]).collect()) == [6, 12]
    assert steps.digest(["scale:by=3;column=v"]) == steps.digest(["scale: column=v; by=3"]) != steps.digest(["scale:by=4;column=v"])
    calls.clear()
    for _ in range(2):
        assert sorted(r.v for r in steps.kept(spark, str(tmp_path), df, ["scale:by=5"]).collect()) == [5, 10]
    assert calls == ["5"]
    for bad in ("nothing:by=1", "scale:by"):
        with pytest.raises(ValueError):
            steps.parse(bad)
