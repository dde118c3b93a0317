"""Perceptual hashes of small images and the exact Hamming join, over disjoint bit bands or in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.graph import cut

BLOCK = 8192  # values on a side of a block of comparisons, on average
WIDE = 1 / 64  # share of all pairs that bands may meet; beyond it blocks are cheaper


def pack_bits(bits: Column) -> Column:
    """A signed 64-bit hash of 64 booleans, the first bit the sign."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b.cast("long")))


def average_hash(pixels: Column) -> Column:
    """Bit per pixel of an 8x8 image: above the mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(pixels)
    return pack_bits(F.transform(pixels, lambda v: v.cast("double") > mean))


def difference_hash(pixels: Column, width: int = 8) -> Column:
    """Bit per neighbouring pair of an image of rows of width + 1 pixels: the left one is darker than the right one."""
    places = F.filter(F.sequence(F.lit(0), F.size(pixels) - 2), lambda i: i % (width + 1) < width)
    return pack_bits(F.transform(places, lambda i: F.get(pixels, i) < F.get(pixels, i + 1)))


def _banded(values: DataFrame, limit: int) -> DataFrame:
    """h, g, distance of values h <= g within limit that agree on one of limit + 1 disjoint bands of bits."""
    bands = limit + 1
    edges = [64 * k // bands for k in range(bands + 1)]
    mask = lambda k: (1 << (edges[k + 1] - edges[k])) - 1
    bits = lambda h, k: F.shiftrightunsigned(h, edges[k]).bitwiseAND(F.lit(mask(k) if mask(k) < 1 << 63 else -1).cast("long"))
    keyed = values.select("h", F.posexplode(F.array(*[bits(F.col("h"), k) for k in range(bands)])).alias("band", "bits"))
    left, right = keyed.alias("l"), keyed.select(F.col("h").alias("g"), "band", "bits").alias("r")
    both = left.join(right, ["band", "bits"]).where("h <= g").withColumn("distance", F.bit_count(F.col("h").bitwiseXOR(F.col("g")))).where(F.col("distance") <= limit)
    earlier = F.lit(False)
    for k in range(bands):
        earlier = earlier | ((F.col("band") > k) & (bits(F.col("h"), k) == bits(F.col("g"), k)))
    return both.where(~earlier).select("h", "g", "distance")


def _compared(limit: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        h, first, i, j = (table.column(c).to_numpy() for c in ("h", "block", "i", "j"))
        own = i[0] == j[0] if len(i) else True
        x = h[first == i]
        y = x if own else h[first == j]
        out = []
        for k in range(0, len(x), 16):
            a = x[k : k + 16]
            distance = np.bitwise_count((a[:, None] ^ y[None, :]).view(np.uint64))  # of signed numbers it counts the bits of the absolute value
            met = (distance <= limit) & (a[:, None] <= y[None, :]) if own else distance <= limit
            at = np.flatnonzero(met)
            left, right = a[at // len(y)], y[at % len(y)]
            out.append((np.minimum(left, right), np.maximum(left, right), distance.ravel()[at].astype(np.int32)))
        kinds = (np.int64, np.int64, np.int32)
        told = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.zeros(0, k) for k in kinds]
        return pa.table(dict(zip(("h", "g", "distance"), told, strict=True)))

    return run


def _blocked(values: DataFrame, limit: int) -> DataFrame:
    """h, g, distance of values h <= g within limit: every block of values is compared with every other one and itself.

    The comparisons are all pairs of values, dealt out by pairs of blocks; what a task holds has a bound.
    """
    values = cut(values)
    blocks = max(1, -(-values.count() // BLOCK))
    held = values.select("h", F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("block"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    met = held.select("h", "block", other.alias("o")).select("h", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    # a few bytes make much work here, so the number of tasks is given
    return met.repartition(min(1000, blocks * (blocks + 1) // 2), "i", "j").groupBy("i", "j").applyInArrow(_compared(limit), "h long, g long, distance int")


def hamming_pairs(df: DataFrame, key: str, hash_col: str, limit: int) -> DataFrame:
    """a, b, distance of all pairs a < b whose hashes differ in at most limit bits; null hashes take no part.

    limit + 1 disjoint bands of bits: two hashes within the limit agree on one of them, so an equi-join on
    (band, bits) meets every pair; each pair is kept in its first common band, without a distinct. Where bands are so
    narrow that they meet a large share of all pairs, all values are compared in blocks instead. Equal hashes
    are joined as one value, so a value that many rows share costs one probe, and is then expanded.
    """
    bands = limit + 1
    rows = df.where(F.col(hash_col).isNotNull()).select(F.col(key).alias("k"), F.col(hash_col).alias("h"))
    values = rows.select("h").distinct()
    near = (_blocked if bands > WIDE * 2 ** (64 // bands) else _banded)(values, limit)
    a, b = rows.toDF("ka", "h"), rows.toDF("kb", "g")
    out = near.join(a, "h").join(b, "g").where("(h < g) or ka < kb")
    return out.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "distance")
