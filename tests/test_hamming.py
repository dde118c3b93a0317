"""The Hamming join at wide limits."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import hashing


@pytest.mark.parametrize("limit", [17, 64])
def test_wide_limits_in_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(hashing, "BLOCK", 60)
    random.seed(limit)
    hashes = [random.getrandbits(64) - (1 << 63) for _ in range(150)]
    hashes += [h ^ random.getrandbits(18) for h in hashes] + hashes[:40] + [-1, 0, (1 << 63) - 1, -(1 << 63)]
    rows = list(enumerate(hashes))
    want = sorted((a, b, d) for a, h in rows for b, g in rows if a < b and (d := ((h ^ g) & (1 << 64) - 1).bit_count()) <= limit)
    df = spark.createDataFrame([*rows, (999, None)], "k long, h long")
    assert sorted(tuple(r) for r in hashing.hamming_pairs(df, "k", "h", limit).collect()) == want
    assert hashing.hamming_pairs(df.limit(0), "k", "h", limit).count() == 0


def test_wide_limits_meet_no_pair_twice(spark, monkeypatch):
    """Bands of three or four bits made more rows than there are pairs of values; now only near pairs leave the comparison."""
    monkeypatch.setattr(hashing, "BLOCK", 300)
    df = spark.range(2000).select(F.col("id").alias("k"), F.xxhash64("id").alias("h"))
    plan = hashing.hamming_pairs(df, "k", "h", 17)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "band" not in plan
