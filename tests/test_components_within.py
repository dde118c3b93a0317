"""Components of many groups at once against a plain union, and masks without broadcasts."""

import random

from pyspark.sql import functions as F

from corvane.operators import graph, masks


def plain(edges):
    root = {}
    for g, a, b in edges:
        for v in (a, b):
            root.setdefault((g, v), v)
    moved = True
    while moved:
        moved = False
        for g, a, b in edges:
            m = min(root[g, a], root[g, b])
            moved |= root[g, a] != m or root[g, b] != m
            root[g, a] = root[g, b] = m
    return {(g, v, r) for (g, v), r in root.items()}


def test_components_within(spark):
    random.seed(3)
    edges = [(g, random.randrange(-30, 60), random.randrange(-30, 60)) for g in [None, *range(40)] for _ in range(30)]
    edges += [(100, k + 1, k) for k in range(400)] + [(101, -1, -1), (102, 1 << 40, -(1 << 40))]
    random.shuffle(edges)
    pairs = spark.createDataFrame(edges, "g int, a long, b long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", before):  # groups longer than a batch, and all in one
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert {tuple(r) for r in graph.components_within(pairs, "g", "a", "b").collect()} == plain(edges)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert graph.components_within(pairs.limit(0), "g", "a", "b").count() == 0


def test_masks_broadcast_nothing(spark):
    df = spark.range(60).select("id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (F.xxhash64("id", k) % 2) == 0).alias("m"))
    sizes = df.select(F.col("id").alias("image"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    runs = masks.mask_runs(df, "id", F.col("m"), 8)
    for out in (masks.labelled(runs), masks.filled(masks.largest_component(runs), sizes), masks.geometry(runs, sizes, runs)):
        assert out.count()
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
