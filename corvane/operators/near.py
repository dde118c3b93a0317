"""Near-duplicate images end to end: hashes, candidates, structural similarity, sides, conflicts and groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.copies import class_groups, content_classes, pair_counts
from corvane.operators.graph import cut
from corvane.operators.hashing import hamming_pairs, pack_bits

#: What of each row is told on both sides of a pair.
FIELDS = ("dataset", "sample_id", "label_name", "label", "used", "grp", "split", "fold")
SIGMA, RADIUS = 1.5, 6  # of the Gaussian window: four deviations, rounded
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def cosine_hash(pixels: Column, side: int, low: int = 8) -> Column:
    """Bit for each of the low x low first cosine coefficients of a side x side image: above the median of all but the first.

    The transform is two products with a constant basis, as array expressions.
    """
    k, n = np.meshgrid(np.arange(low), np.arange(side), indexing="ij")
    basis = np.cos(np.pi * k * (2 * n + 1) / (2 * side)) * np.where(k == 0, np.sqrt(1 / side), np.sqrt(2 / side))
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in basis])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    lines = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda y: F.transform(F.slice(pixels, y * side + 1, side), lambda v: v.cast("double")))
    # along x for every line, then along y for every coefficient of the lines
    along = F.transform(lines, lambda line: F.transform(rows, lambda b: dot(line, b)))
    grid = F.flatten(F.transform(rows, lambda b: F.transform(F.sequence(F.lit(0), F.lit(low - 1)), lambda u: F.aggregate(F.zip_with(along, b, lambda line, w: F.get(line, u) * w), F.lit(0.0), lambda s, x: s + x))))
    rest = F.sort_array(F.slice(grid, 2, low * low - 1))
    middle = F.get(rest, (low * low - 2) // 2) if (low * low - 1) % 2 else (F.get(rest, (low * low - 3) // 2) + F.get(rest, (low * low - 1) // 2)) / 2
    held = F.transform(F.array(F.struct(grid.alias("g"), middle.alias("m"))), lambda x: pack_bits(F.transform(x["g"], lambda v: v > x["m"])))
    return F.get(held, 0)


def _blur(x: np.ndarray) -> np.ndarray:
    """Separable Gaussian over the last two axes; edges are mirrored with the edge pixel repeated."""
    w = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    w /= w.sum()
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (RADIUS, RADIUS)
        p = np.pad(x, pad, mode="symmetric")
        x = sum(w[k] * np.take(p, np.arange(k, k + x.shape[axis]), axis=axis) for k in range(2 * RADIUS + 1))
    return x


def structural_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean similarity of each pair of equal-size grey images (0 to 255) under a Gaussian window."""
    ma, mb = _blur(a), _blur(b)
    va, vb, cov = _blur(a * a) - ma * ma, _blur(b * b) - mb * mb, _blur(a * b) - ma * mb
    return (((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))).mean(axis=(1, 2))


def _similar(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                batch = whole.slice(k, 128)
                read = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)  # noqa: E731, B023
                sides = []
                for x in (read("image_a"), read("image_b")):
                    side = int(round(x.shape[1] ** 0.5))
                    f = max(1, side // size)
                    x = x.reshape(-1, side, side)
                    sides.append(x if f == 1 else x[:, : side // f * f, : side // f * f].reshape(len(x), side // f, f, side // f, f).mean(axis=(2, 4)))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(structural_similarity(*sides))], ["a", "b", "ssim"])

    return run


def similarity(pairs: DataFrame, images: DataFrame, key: str, pixels: str, size: int = 64) -> DataFrame:
    """a, b, ssim of pairs(a, b): images are square, of one size, and averaged in blocks down to about size."""
    side = lambda s: images.select(F.col(key).alias(s), F.col(pixels).alias(f"image_{s}"))
    types = dict(pairs.dtypes)
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "image_a", "image_b").mapInArrow(_similar(size), f"a {types['a']}, b {types['b']}, ssim double")


def candidates(df: DataFrame, key: str, hashes: Sequence[str], limit: int = 4, group: str | None = None) -> DataFrame:
    """a, b and the distance of each hash, for all pairs a < b of which some hash differs in at most limit bits.

    Rows without one of the hashes take no part. With group, pairs of equal group go, and rows without a group
    count as one group.
    """
    held = df.where(" and ".join(f"{h} is not null" for h in hashes))
    pairs = None
    for h in hashes:
        near = hamming_pairs(held, key, h, limit).select("a", "b")
        pairs = near if pairs is None else pairs.union(near)
    side = lambda s: held.select(F.col(key).alias(s), *[F.col(h).alias(f"{h}_{s}") for h in hashes], *([F.col(group).alias(f"_g{s}")] if group else []))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    if group:
        both = both.where(~F.col("_ga").eqNullSafe(F.col("_gb")))
    return both.select("a", "b", *[F.bit_count(F.col(f"{h}_a").bitwiseXOR(F.col(f"{h}_b"))).alias(f"{h}_dist") for h in hashes])


def dense_groups(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, ...) with group_id: groups of linked ends, numbered from 0 by their first pair in order of (a, b);
    an end may be paired with itself.

    Numbers come from ranks within buckets of roots, so no task orders all groups.
    """
    roots = class_groups(pairs)
    placed = pairs.join(roots.withColumnRenamed("class_id", "a"), "a")
    first = placed.groupBy("root").agg(F.min(F.struct("a", "b")).alias("at"))
    # a component's first pair begins at its root, the smallest node, so roots are in the order of first pairs
    spread = first.select("root", F.col("root").cast("string").alias("_s"))
    buckets = cut(spread.repartitionByRange("root").select("root", F.spark_partition_id().alias("bucket")))
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    before = counts.select(F.col("bucket"), (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("root")) - 1
    ids = buckets.withColumn("_k", rank).join(before, "bucket").select("root", (F.col("before") + F.col("_k")).alias("group_id"))
    return placed.join(ids, "root").drop("root")


class Duplicates(NamedTuple):
    """What find_duplicates() finds; all of it is about classes of equal pixels, named by their smallest key."""

    #: a, b, distances, ssim, the counts of pair_counts(), FIELDS of both named rows, and group_id; a = b within a class.
    pairs: DataFrame
    #: a, b and distances of all classes that were compared.
    candidates: DataFrame
    #: class_id of every row that has all hashes, beside its own columns.
    members: DataFrame


def find_duplicates(
    df: DataFrame, key: str, pixels: str, hashes: Sequence[str] = ("ahash", "dhash", "phash"), limit: int = 4, threshold: float = 0.95, other_groups_only: bool = False, size: int = 64
) -> Duplicates:
    """Confirmed near copies, by classes of equal pixels.

    df has key, pixels (array of a square image), the hashes and FIELDS (fields it lacks are null). One image of each
    class is compared with those of near hashes; pairs of classes of at least the threshold stay, and so do classes
    of two rows or more (ssim 1). Every pair of members counts, so no leak or conflict hides behind a class's first
    row. other_groups_only leaves out pairs within one group, and classes and links that have no others.
    """
    lacking = [f for f in FIELDS if f not in df.columns]
    rows = df.select("*", *[F.lit(None).cast("boolean" if f == "used" else "string").alias(f) for f in lacking])
    whole = rows.where(" and ".join(f"{h} is not null" for h in hashes))
    members = cut(content_classes(whole, key, F.sha2(F.to_json(pixels), 256)))
    reps = members.where(F.col(key) == F.col("class_id"))
    tried = cut(candidates(reps, key, hashes, limit))
    links = cut(tried.join(similarity(tried, reps, key, pixels, size).where(F.col("ssim") >= threshold), ["a", "b"]))
    counts = cut(pair_counts(members.withColumn("used", F.coalesce("used", F.lit(True))), links, other_groups_only))
    zero = [F.coalesce(f"{h}_dist", F.lit(0)).alias(f"{h}_dist") for h in hashes]
    found = counts.join(links, ["a", "b"], "left").select(*counts.columns, *zero, F.coalesce("ssim", F.lit(1.0)).alias("ssim"))
    side = lambda s: reps.select(F.col(key).alias(s), *[F.col(f).alias(f"{f}_{s}") for f in FIELDS])
    return Duplicates(dense_groups(cut(found.join(side("a"), "a").join(side("b"), "b"))), tried, members)
