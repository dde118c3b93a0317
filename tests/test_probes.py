"""Forests, probes and clusters on data whose answers are known."""

import numpy as np
import pytest

from corvane.operators import probes as P


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        s = k % 3
        x = rng.normal(size=3)
        rows.append((k, f"s{s}", int(rng.random() < (0.2, 0.5, 0.8)[s]), float(x[0] + 4 * s), float(x[1]), None if k % 17 == 0 else float(x[2])))
    rows[7] = (7, "s1", 1, 4.0, 60.0, 0.0)
    rows[8] = (8, "s2", 1, -9.0, -3.0, 3.5)
    return spark.createDataFrame(rows, "id long, src string, y int, a double, b double, c double").repartition(4)


def test_forest_and_flags(df):
    scores = {r.id: r.score for r in P.isolation_scores(df, "id", "src", ["a", "b", "c"]).collect()}
    assert len(scores) == 300 and all(0 < s < 1 for s in scores.values()) and max(scores, key=scores.get) in (7, 8)
    got = {r.id: r for r in P.flag_outliers(df, "id", "src", ["a", "b", "c"]).collect()}
    assert got[7].forest_flag and got[7].reasons.startswith("b(z=+")
    for s in range(3):  # a hundred rows each: the largest score alone exceeds the 99 % quantile
        own = {k: v for k, v in scores.items() if (k % 3 if k not in (7, 8) else k - 6) == s}
        assert [k for k, r in got.items() if r.src == f"s{s}" and r.forest_flag] == [max(own, key=own.get)]
    only = [r for r in got.values() if r.reasons == "isolation_forest"]
    assert all(r.forest_flag and r.max_abs_z is None for r in only)
    few = P.flag_outliers(df.where("id < 15"), "id", "src", ["a", "b"], 1.5).collect()
    assert few and not any(r.forest_flag for r in few)


def test_datasets_apart_and_missing_values(df, monkeypatch):
    """Nineteen rows far away get no forest and don't move the others'; NaN is missing; shares of few rows score alike."""
    far = df.sparkSession.createDataFrame([(1000 + k, "far", 0, 1e6 + k, 0.0, float("nan")) for k in range(19)], df.schema)
    both = df.union(far)
    odd = P.flag_outliers(both, "id", "src", ["a", "b", "c"]).collect()
    alone = P.flag_outliers(df, "id", "src", ["a", "b", "c"]).collect()
    assert sorted(odd) == sorted(alone)
    with_nan = df.selectExpr("id", "src", "y", "a", "b", "nvl(c, double('NaN')) as c")
    assert sorted(P.flag_outliers(with_nan, "id", "src", ["a", "b", "c"]).collect()) == sorted(alone)
    monkeypatch.setattr(P, "SHARE", 7)
    assert sorted(P.flag_outliers(df, "id", "src", ["a", "b", "c"]).collect()) == sorted(alone)
    assert P.flag_outliers(df.limit(0), "id", "src", ["a"]).count() == 0

def test_source_probes(df):
    got = {r.name: r for r in P.source_probes(df, "id", "src", {"all": ["a", "b", "c"], "noise": ["c"]}, 3).collect()}
    assert got["all"].accuracy > 0.9 and got["noise"].accuracy < 0.5 and got["all"].chance == pytest.approx(1 / 3) and got["all"].n == 300


def test_label_probe(df):
    assert P.label_probe(df, "id", "y", attribute="src", k=3).first().auc > 0.65
    assert abs(P.label_probe(df, "id", "y", features=["c"], k=3).first().auc - 0.5) < 0.12


def test_clusters_keep_their_numbers(df):
    first = P.stable_clusters(df, "id", ["a"], 3).cache()
    turned = first.selectExpr("id", "(cluster + 1) % 3 as cluster")
    again = {r.id: r.cluster for r in P.stable_clusters(df, "id", ["a"], 3, turned, seed=7).collect()}
    want = {r.id: r.cluster for r in turned.collect()}
    assert np.mean([again[k] == want[k] for k in want]) > 0.95
