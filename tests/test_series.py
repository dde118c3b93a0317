"""Summaries and series whose answers need no SQL twin: draws, averages, grids and fold protocols."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import series as R
from corvane.operators import splits as S
from corvane.operators import summary as Y


def test_moving_average(spark):
    rows = [("a", k, float(v)) for k, v in enumerate([4, 2, 8, 1])] + [("b", 1, 3.0)]
    got = {(r.run, r.step): r.ema for r in R.moving_average(spark.createDataFrame(rows, "run string, step int, loss double"), ["run"], "step", "loss", 0.9).collect()}
    want, e = {}, None
    for run, k, v in rows:
        e = v if k == 0 or run == "b" else 0.9 * e + 0.1 * v
        want[run, k] = e
    assert got == pytest.approx(want)


def test_weighted_draws(spark):
    rows = [(k, float(w)) for k, w in enumerate([1, 0, 5, 2, 0.5, 30] + [0.1] * 50)] + [(98, None), (99, -1.0)]
    df = spark.createDataFrame(rows, "id long, w double").repartition(4)
    got = R.weighted_draws(df, "id", "w", 4000, 7).collect()
    assert sorted(r.draw for r in got) == list(range(4000)) and not {r.id for r in got} & {1, 98, 99}
    total = sum(w for _, w in rows if w and w > 0)
    for k in (0, 2, 5):
        share = np.mean([r.id == k for r in got])
        assert abs(share - rows[k][1] / total) < 0.04
    assert {(r.draw, r.id) for r in got} == {(r.draw, r.id) for r in R.weighted_draws(df, "id", "w", 4000, 7).collect()}
    assert R.weighted_draws(df.where("w < 0"), "id", "w", 5, 1).count() == 0


def test_patience_without_improvement(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 0.5), ("a", 3, 0.5), ("a", 4, 0.6)], "run string, e int, auc double")
    got = [(r.e, r.improved, r.stale, r.best) for r in R.with_patience(df, ["run"], "e", "auc").orderBy("e").collect()]
    assert got == [(1, False, 1, None), (2, True, 0, 0.5), (3, False, 1, 0.5), (4, True, 0, 0.6)]
    r = R.early_stop(df, ["run"], "e", "auc", 1).first()
    assert (r.stop_at, r.best_at, r.best) == (1, None, None)


def test_small_picks(spark):
    df = spark.createDataFrame([(k % 3, k, float(-k)) for k in range(9)], "g int, id int, v double")
    assert [(r.g, r.id) for r in R.first_per_group(df, "g", ["v"], 2).orderBy("g").collect()] == [(0, 6), (1, 7)]
    ids = [r.id for r in R.subset_in_order(df, "id", 4, 1).collect()]
    assert ids == sorted(ids) and len(ids) == 4
    grid = spark.createDataFrame([("c", 2, 5), ("c", 1, 9), ("c", 1, 3)], "case string, phase int, z int")
    assert sorted((r.phase, r.z, r.phase_no, r.slice_no) for r in R.phase_grid(grid, "case", "phase", "z").collect()) == [(1, 3, 1, 1), (1, 9, 1, 2), (2, 5, 2, 1)]


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1.0, True, [1.0, 2.0]), ("a", 3.0, None, [3.0, 6.0]), ("b", None, False, [5.0, 5.0])], "s string, v double, f boolean, px array<double>")
    assert [(r.s, r.v) for r in Y.quartile_text(df, ["s"], ["v"]).orderBy("s").collect()] == [("a", "2.0 [1.5, 2.5]"), ("b", None)]
    assert tuple(Y.conditional_counts(df, {"f": F.col("f"), "big": F.col("v") > 2}).first()) == (1, 1)
    assert df.where(Y.any_over(["v"], 2)).count() == 1
    images = {r.s: (r.n, r["mean"], r["std"]) for r in Y.mean_image(df, ["s"], "px").collect()}
    assert images == {"a": (2, [2.0, 4.0], [1.0, 2.0]), "b": (1, [5.0, 5.0], [0.0, 0.0])}
    sums = spark.createDataFrame([(10.0, 2), (20.0, 8)], "t double, n int")
    assert Y.pooled_mean(sums, "t", "n").first()["mean"] == 3.0
    acc = spark.createDataFrame([(1, 1, "s", [True, False]), (0, 1, "s", [True, True]), (0, 0, "t", [False, True])], "p int, y int, src string, on array<boolean>")
    assert {r.name: (r.n, r.accuracy) for r in Y.accuracy_table(acc, "p", "y", "src", "on").collect()} == {"s": (2, 0.5), "t": (1, 1.0), "overall": (3, pytest.approx(2 / 3)), "single": (2, 1.0)}


def test_fold_protocols(spark):
    rows = [(k, f"P{k // 3}", (k // 3) % 2, "s1" if k < 30 else "s2", k % 5 + 1) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, patient string, y int, src string, official int")
    parts = S.out_of_distribution(df, "src", ["s2"], "patient", "y", "id", 4, 1).collect()
    assert {r.part for r in parts if r.src == "s2"} == {"ood"} and {r.part for r in parts if r.src == "s1"} <= {"1", "2", "3", "4"} and len(parts) == 60
    by_patient = {}
    for r in S.patient_folds(df, "patient", "y", 4, 3, 3).collect():
        by_patient.setdefault(r.patient, set()).add((r.fold, r.split))
    assert all(len(v) == 1 for v in by_patient.values()) and {s for v in by_patient.values() for s in v} == {(0, "val"), (1, "train"), (2, "train"), (3, "test")}
    both = S.fold_of_source(df, "src", {"s1": ("group_holdout", {"group": "patient", "seed": 1, "fraction": S.held_fraction(0.1, True)}), "s2": ("official_kfold", {"fold": "official", "group": "id", "test_fold": 2, "seed": 1, "holdout": 0.2})}).collect()
    assert len(both) == 60 and sum(r.split == "val" for r in both if r.src == "s1") == 6 and {r.official for r in both if r.src == "s2" and r.split == "test"} == {2}
    with pytest.raises(ValueError):
        S.fold_of_source(df, "src", {"s1": ("nothing", {})})
