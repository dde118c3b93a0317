"""Statistics of model comparisons against plain numpy versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import comparison as C
from corvane.operators import evaluation as V


def plain_auc(y, s):
    y, s = np.asarray(y), np.asarray(s, float)
    p, q = s[y == 1], s[y == 0]
    return float(((p[:, None] > q[None]) + 0.5 * (p[:, None] == q[None])).mean()) if len(p) and len(q) else None


@pytest.fixture(scope="module")
def pred(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(160):
        y = int(rng.random() < 0.4)
        rows.append((k % 4, f"i{k}", k, f"g{k // 3}", y, float(np.round(rng.normal(y, 1), 1)), float(np.round(rng.normal(y * 0.5, 1), 1))))
    return spark.createDataFrame(rows, "fold int, image string, pos int, grp string, y int, a double, b double").repartition(5), rows


def test_auc_by_ranges(pred):
    df, rows = pred
    assert V.auc(df, "a", "y").first().auc == pytest.approx(plain_auc([r[4] for r in rows], [r[5] for r in rows]))
    got = {r.fold: r.auc for r in V.auc(df, "a", "y", ["fold"]).collect()}
    assert got == pytest.approx({k: plain_auc([r[4] for r in rows if r[0] == k], [r[5] for r in rows if r[0] == k]) for k in range(4)})


def plain_delong(rows):
    y, a, b = (np.array([r[k] for r in rows]) for k in (4, 5, 6))
    parts = []
    for s in (a, b):
        psi = (s[y == 1][:, None] > s[y == 0][None]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None])
        parts.append((psi.mean(1), psi.mean(0), psi.mean()))
    v = np.var(parts[0][0] - parts[1][0], ddof=1) / (y == 1).sum() + np.var(parts[0][1] - parts[1][1], ddof=1) / (y == 0).sum()
    return parts[0][2] - parts[1][2], math.erfc(abs(parts[0][2] - parts[1][2]) / math.sqrt(v) / math.sqrt(2))


def test_delong(pred):
    df, rows = pred
    r = C.delong_p(df, "y", "a", "b").first()
    gap, p = plain_delong(rows)
    assert (r.auc_a - r.auc_b, r.p) == pytest.approx((gap, p))
    assert C.delong_p(df, "y", "a", "a").first().p == 1.0


def test_fold_mean_draws(pred):
    import hashlib

    df, rows = pred
    for shared in (False, True):
        want = {}
        for rep in range(1, 6):
            gaps = []
            for k in range(4):
                own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[4], r[5], r[6]))
                pick = [own[int(hashlib.md5(f"3:{rep}:{'all' if shared else k}:{j}".encode()).hexdigest()[:12], 16) % len(own)] for j in range(len(own))]
                x, z = (plain_auc([r[4] for r in pick], [r[c] for r in pick]) for c in (5, 6))
                gaps.append(None if x is None else x - z)
            if None not in gaps:
                want[rep] = np.mean(gaps)
        got = {r.replicate: r.delta for r in C.fold_mean_draws(df, "fold", "image", "y", "a", "b", 5, 3, shared).collect()}
        assert got == pytest.approx(want)
    r = C.fold_mean_delta(df, "fold", "image", "y", "a", "b", 50, 3).first()
    assert r.delta_lower <= r.delta_mean <= r.delta_upper and 0 <= r.p <= 1 and r.draws <= 50


def test_summaries(pred):
    df, rows = pred
    assert not C.same_images(df, "fold", "image", "pos")
    twice = df.where("fold = 0").unionByName(df.where("fold = 0").withColumn("fold", F.lit(1)))
    assert C.same_images(twice, "fold", "image", "pos")
    r = C.compare_models(df, "fold", "image", "pos", "y", "a", "b", 20).first()
    gap, p = plain_delong(rows)
    assert not r.fixed_split and r.n == 160 and (r.pooled_delta, r.pooled_p) == pytest.approx((gap, p))
    fixed = C.compare_models(twice, "fold", "image", "pos", "y", "a", "b", 20).first()
    assert fixed.fixed_split and fixed.n == 40 and fixed.pooled_p is None
    g = C.group_bootstrap(df, "grp", "y", "a", "b", 40, 1).first()
    assert g.auc_a_lower <= plain_auc([r[4] for r in rows], [r[5] for r in rows]) <= g.auc_a_upper and 0 <= g.p_not_better <= 1
    folds = {r.fold: (r.n, r.auc) for r in C.fold_table(df, "fold", "y", "a").collect()}
    assert folds["pooled"] == (160, pytest.approx(plain_auc([r[4] for r in rows], [r[5] for r in rows]))) and len(folds) == 5


def test_multiclass(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([1, 1, 1], 90)
    y = rng.integers(0, 3, 90)
    df = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(y, p)], "y int, p0 double, p1 double, p2 double")
    names = ["p0", "p1", "p2"]
    got = {r.name: r.auc for r in C.multiclass_auc(df, "y", names).collect()}
    each = [plain_auc((y == k).astype(int), p[:, k]) for k in range(3)]
    want = {str(k): v for k, v in enumerate(each)} | {"macro": np.mean(each), "micro": plain_auc(np.concatenate([(y == k).astype(int) for k in range(3)]), np.concatenate([p[:, k] for k in range(3)]))}
    assert got == pytest.approx(want)
    rows = y > 0
    assert C.one_of_two_auc(df, "y", names).first().auc == pytest.approx(plain_auc((y[rows] == 2).astype(int), (p[rows, 2] / (p[rows, 1] + p[rows, 2]))))

    def curve(t, s):
        points = [(0.0, 0.0)] + [((s[t == 0] >= v).mean(), (s[t == 1] >= v).mean()) for v in sorted(set(s), reverse=True)]
        x, z = zip(*points)
        best = max(b if c <= 0.1 else a + (0.1 - w) * (b - a) / (c - w) for (w, a), (c, b) in zip(points, points[1:]) if w <= 0.1)
        low = next(w + (0.9 - a) * (c - w) / (b - a) for (w, a), (c, b) in zip(points, points[1:]) if b >= 0.9)
        return best, 1 - low

    means = np.mean([curve((y == k).astype(int), p[:, k]) for k in range(3)], axis=0)
    r = C.mean_operating_points(df, "y", names).first()
    assert (r.sensitivity, r.specificity) == pytest.approx(tuple(means))


def test_rows_and_classes(spark):
    r = spark.range(1).select(C.softmax(F.array(F.lit(1.0), F.lit(1.0), F.lit(1000.0))).alias("s"), C.argmax(F.array(F.lit(2.0), F.lit(2.0))).alias("k")).first()
    assert r.s == pytest.approx([0, 0, 1]) and r.k == 0
    df = spark.createDataFrame(list(zip([0.8, 0.7, 0.1, 0.1, 0.9, 0.9], [0, 0, 0, 0, 1, 1])), "p double, y int").withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    conf = V.confusion(df, "pred", "y")
    assert tuple(conf.first()) == (2, 2, 0, 2)
    got = {r.cls: (r.support, r.precision, r.recall) for r in C.per_class_table(df, "pred", "y").collect()}
    assert got == {0: (4, 1.0, 0.5), 1: (2, 0.5, 1.0)}
    pooled = C.pooled_confusion(conf.union(conf)).first()
    assert (pooled.tn, pooled.tp, pooled.sensitivity) == (4, 4, 1.0)


def test_stacking(pred):
    df, rows = pred
    got = C.stacked(df, "fold", "y", ["a", "b"]).collect()
    assert len(got) == len(rows)
    both = plain_auc([r.y for r in got], [r.stacked for r in got])
    assert both > plain_auc([r[4] for r in rows], [r[6] for r in rows])
