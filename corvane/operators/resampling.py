"""Bootstrap of AUCs with a vector of replicate weights beside every row.

Each group counts in each replicate as often as a Poisson law of mean 1 says, by a hash of the group and the replicate:
the usual stand-in for drawing whole groups with replacement where nobody holds all groups. A weight is made where its
row is, so replicates never multiply the rows that travel: rows are sorted by score over range partitions, and a
partition hands on a few sums for each replicate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.comparison import interval
from corvane.operators.graph import cut

#: Bits of a uniform, and the places on it where Poisson weights 1, 2, ... begin.
UNIFORM = 53
CUTS = np.array([int(c * (1 << UNIFORM)) for c in accumulate(math.exp(-1) / math.factorial(k) for k in range(18))], np.uint64)
#: Cells of a weight matrix that are held at a time.
CELLS = 1 << 22
#: Sums of a stretch of scores: of both classes, of won comparisons, and of the first and the last score's own.
SUMS = ("p", "q", "won", "first_p", "first_q", "last_p", "last_q")


def weights(keys: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson weights of groups (rows) in replicates 1 to replicates (columns)."""
    z = keys.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(CUTS, (z ^ (z >> np.uint64(31))) >> np.uint64(64 - UNIFORM), side="right")


def _stretch(score: np.ndarray, y: np.ndarray, keys: np.ndarray, replicates: int) -> dict:
    """Sums of rows in ascending order of score."""
    w = weights(keys, replicates).astype(np.float64)
    start = np.nonzero(np.concatenate([[True], score[1:] != score[:-1]]))[0]
    p, q = np.add.reduceat(w * (y == 1)[:, None], start), np.add.reduceat(w * (y == 0)[:, None], start)
    won = (p * (np.cumsum(q, axis=0) - q / 2)).sum(axis=0)
    return {"low": score[0], "high": score[-1], "p": p.sum(axis=0), "q": q.sum(axis=0), "won": won, "first_p": p[0], "first_q": q[0], "last_p": p[-1], "last_q": q[-1]}


def _joined(a: dict | None, b: dict) -> dict:
    """Sums of two stretches, the second of scores no smaller; a score that ends one and begins the other ties."""
    if a is None:
        return b
    tie = a["high"] == b["low"]
    out = {"low": a["low"], "high": b["high"], "p": a["p"] + b["p"], "q": a["q"] + b["q"], "won": a["won"] + b["won"] + a["q"] * b["p"]}
    if tie:
        out["won"] = out["won"] + (a["last_p"] * b["first_q"] - a["last_q"] * b["first_p"]) / 2
    for c in ("p", "q"):
        out[f"first_{c}"] = a[f"first_{c}"] + (b[f"first_{c}"] if tie and a["low"] == a["high"] else 0)
        out[f"last_{c}"] = b[f"last_{c}"] + (a[f"last_{c}"] if tie and b["low"] == b["high"] else 0)
    return out


def _partial(by: int, replicates: int):
    """Of each (model, by) of a sorted partition its sums."""
    names = ["m", *[f"b{k}" for k in range(by)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, columns = None, None, None

        def told() -> pa.RecordBatch:
            vectors = [pa.array([sums[c].tolist()], pa.list_(pa.float64())) for c in SUMS]
            return pa.RecordBatch.from_arrays([*columns, pa.array([sums["low"]]), pa.array([sums["high"]]), *vectors], [*names, "low", "high", *SUMS])

        for batch in batches:
            own = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            starts = [0, *[k for k in range(1, len(own)) if own[k] != own[k - 1]], len(own)]
            score, y, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "y", "key"))
            for a, b in zip(starts, starts[1:], strict=False):
                if sums is not None and own[a] != now:
                    yield told()
                    sums = None
                now, columns = own[a], [batch.column(c).slice(a, 1) for c in names]
                step = max(1, CELLS // replicates)
                for lo in range(a, b, step):
                    hi = min(b, lo + step)
                    sums = _joined(sums, _stretch(score[lo:hi], y[lo:hi], keys[lo:hi], replicates))
        if sums is not None:
            yield told()

    return run


def _whole(by: int):
    names = ["m", *[f"b{k}" for k in range(by)]]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["low"], r["high"]))
        sums = None
        for r in rows:
            sums = _joined(sums, {"low": r["low"], "high": r["high"]} | {c: np.array(r[c]) for c in SUMS})
        pairs = sums["p"] * sums["q"]
        auc = np.where(pairs > 0, sums["won"] / np.maximum(pairs, 1), np.nan)
        return pa.table([*[table.column(c).slice(0, 1) for c in names], pa.array([auc.tolist()], pa.list_(pa.float64()))], names=[*names, "auc"])

    return run


def auc_replicates(df: DataFrame, group: str, label: str, scores: Sequence[str], replicates: int, seed: int, by: Sequence[str] = (), apart: bool = True) -> DataFrame:
    """by, replicate and, for each score, auc_<score>: its AUC in every replicate, null where a class is absent.

    Rows of one group weigh alike, within each value of by on its own unless apart is false. Rows without a label (0 or
    1), a score or a group take no part. Ties count one half, also across partitions, so a hot score is no hot task.
    """
    by = list(by)
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (by if apart else [])], F.col(group).cast("string"))
    each = F.array(*[F.struct(F.lit(k).alias("m"), F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")).alias("s")) for k, s in enumerate(scores)])
    rows = df.where(F.col(label).isin(0, 1) & F.col(group).isNotNull()).select(*[F.col(c).alias(f"b{k}") for k, c in enumerate(by)], F.col(label).cast("int").alias("y"), F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("key"), F.explode(each).alias("x"))
    names = ["m", *[f"b{k}" for k in range(len(by))]]
    rows = rows.select("x.m", *names[1:], "x.s", "y", "key").where("s is not null")
    placed = rows.repartitionByRange(*names, "s", "key").sortWithinPartitions(*names, "s")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = ", ".join(f"{c} {kinds[c]}" for c in names)
    sums = cut(placed.mapInArrow(_partial(len(by), replicates), f"{head}, low double, high double, " + ", ".join(f"{c} array<double>" for c in SUMS)))
    found = sums.groupBy(*names).applyInArrow(_whole(len(by)), f"{head}, auc array<double>")
    long = found.select(*names, F.posexplode("auc").alias("k", "v"))
    wide = long.groupBy(*names[1:], "k").agg(*[F.max(F.when((F.col("m") == k) & ~F.isnan("v"), F.col("v"))).alias(f"auc_{s}") for k, s in enumerate(scores)])
    return wide.select(*[F.col(f"b{k}").alias(c) for k, c in enumerate(by)], (F.col("k") + 1).cast("long").alias("replicate"), *[f"auc_{s}" for s in scores])


def paired_bootstrap(df: DataFrame, group: str, label: str, a: str, b: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """One row: draws (replicates with both classes), 95 % intervals of both AUCs and of their difference, and
    p_not_better, the share of draws in which a is no better than b."""
    draws = cut(auc_replicates(df, group, label, [a, b], replicates, seed).toDF("replicate", "auc_a", "auc_b").where("auc_a is not null and auc_b is not null").withColumn("delta", F.col("auc_a") - F.col("auc_b")))
    return interval(draws, ["auc_a", "auc_b", "delta"]).crossJoin(F.broadcast(draws.agg(F.avg((F.col("delta") <= 0).cast("double")).alias("p_not_better"), F.count("*").alias("draws"))))


def fold_mean_bootstrap(df: DataFrame, fold: str, image: str, label: str, a: str, b: str, replicates: int = 2000, seed: int = 0, shared: bool = False) -> DataFrame:
    """One row: draws, interval and two-sided p of the mean over folds of the difference of AUCs.

    Images are drawn within each fold, or, with shared, alike in all of them. Only draws count in which every fold has
    both classes.
    """
    each = auc_replicates(df, image, label, [a, b], replicates, seed, [fold], not shared).toDF("fold", "replicate", "auc_a", "auc_b")
    folds = df.select(fold).distinct().count()
    draws = cut(each.groupBy("replicate").agg(F.avg(F.col("auc_a") - F.col("auc_b")).alias("delta"), F.count(F.col("auc_a") + F.col("auc_b")).alias("n")).where(F.col("n") == folds))
    share = lambda c: F.avg(c.cast("double"))
    p = F.least(F.lit(1.0), 2 * F.least(share(F.col("delta") <= 0), share(F.col("delta") >= 0)))
    return interval(draws, ["delta"]).crossJoin(F.broadcast(draws.agg(p.alias("p"), F.count("*").alias("draws"))))
